import numpy as np
from fixtures import docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import outliers


def slow_repeats(words, width=8):
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + width))
    return len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeat_words_equals_brute_force(words):
    assert outliers.repeat_words(words) == slow_repeats(words)


def test_counts_of_a_text():
    text = "One two|three\nOne two|three\n \nA#b $c d"
    n_words, chars, symbols, dup, rep, lines, caps, punct = outliers.text_counts(text)
    assert (n_words, symbols, dup, rep, lines, caps, punct) == (6, 4, 1, 0, 3, 3, 0)
    assert chars == sum(1 for c in text if c not in " \t\n\r\x0b\x0c")


def exact_mcd(x, h=0.75):
    """The same estimate in plain numpy: sorted distances instead of bins,
    and many more random starts."""
    floors = np.array(list(outliers.FLOORS.values())) ** 2
    r = np.random.default_rng(1)
    centre = np.median(x, axis=0)
    starts = [(centre, np.diag((1.4826 * np.median(np.abs(x - centre), axis=0)) ** 2 + floors))]
    for _ in range(30):
        some = x[r.permutation(len(x))[:7]]
        starts.append((some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(floors)))

    def step(centre, scatter, share):
        d = np.einsum("nd,nd->n", (x - centre) @ np.linalg.inv(scatter), x - centre)
        own = x[np.argsort(d)[:int(np.ceil(h * len(x)))]] if share == h else x[d <= outliers._chi2_quantile(0.975, x.shape[1])]
        return own.mean(axis=0), np.cov(own.T, bias=True) * outliers._consistency(share) + np.diag(floors)

    best = None
    for estimate in starts:
        for _ in range(20):
            estimate = step(*estimate, h)
            det = np.linalg.slogdet(estimate[1])[1]
            if best is None or det < best[0]:
                best = det, estimate
    return (*step(*best[1], 0.975), best[0])


def test_chi2_quantile():
    assert abs(outliers._chi2_quantile(0.975, 6) - 14.449) < 0.1
    assert abs(outliers._chi2_cdf(14.449, 6) - 0.975) < 0.002


def test_estimate_equals_brute_force_and_rejects_junk(spark):
    rows = [(i, prose(i, 120 + i % 50) + ". " + prose(1000 + i, 30), "en", "a") for i in range(150)]
    junk = [(1000 + i, " ".join(w + "***" for w in prose(5000 + i, 100).split()), "en", "a") for i in range(20)]
    copies = [(2000 + i, rows[0][1], "en", "a") for i in range(300)]
    judged, names = outliers.quality_rules(docs(spark, rows + junk + copies))
    got = {r["doc_id"]: r for r in judged.collect()}
    assert all(got[d][names["kept"]] for d, *_ in rows + copies)
    assert not any(got[d][names["kept"]] for d, *_ in junk)
    x = np.unique(np.array([r[names["vector"]] for r in got.values() if not r[names["base_failed"]]]), axis=0)
    centre, scatter, log_det = exact_mcd(x)
    for r in got.values():
        delta = np.array(r[names["vector"]]) - centre
        want = delta @ np.linalg.solve(scatter + np.diag(r[names["noise"]]), delta)
        assert abs(r[names["distance"]] - want) < 0.15 * want + 0.05


def test_edge_rows(spark):
    df = docs(spark)
    judged, names = outliers.quality_rules(df, min_rows=4)
    got = judged.collect()
    assert len(got) == df.count() and set(df.columns) <= set(judged.columns)
    assert names["kept"] != "kept" and names["kept"] != "mcd_kept"
    empty = [r for r in got if not (r["text"] or "").strip()]
    assert empty and all(r[names["n_words"]] == 0 and r[names["base_failed"]] and not r[names["kept"]] for r in empty)
    assert outliers.quality_rules(df.limit(0))[0].count() == 0


def test_the_least_determinant_of_several_starts_is_kept(spark):
    """Two clouds: the median lies between them, only one holds most vectors."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 0.05, (240, 6)), r.normal(0.9, 0.3, (80, 6))])
    names = {"base_failed": "failed", "group": "g", "vector": "x"}
    stats = spark.createDataFrame([(False, "g", "en", [round(float(c), 6) for c in v]) for v in x], "failed boolean, g string, lang string, x array<double>")
    one = outliers.fit(stats, names, starts=1).first()
    many = outliers.fit(stats, names).first()
    assert many["log_det"] <= one["log_det"] + 1e-6
    _, _, want = exact_mcd(np.round(x, 6))
    assert many["log_det"] <= want + 0.15
    assert np.abs(np.array(many["mean"])).max() < 0.05


def test_a_text_of_repeated_lines_is_rejected(spark):
    def text(i):
        return "\n".join(prose(100 * i + k, 12) for k in range(30))

    def spread(i):  # the repeats lie apart, each followed by another line, and are short
        lines = [prose(9000 + k, 3) for k in range(4)]
        return "\n".join(f"{lines[k % 4]}\n{prose(10_000 + 100 * i + k, 6)}" for k in range(120))

    clean = [(i, text(i), "en", "a") for i in range(80)]
    judged, names = outliers.quality_rules(docs(spark, clean + [(500, spread(1), "en", "a")]))
    got = {r["doc_id"]: r for r in judged.collect()}
    assert not got[500][names["base_failed"]] and not got[500][names["kept"]]
    assert all(got[i][names["kept"]] for i, *_ in clean)
