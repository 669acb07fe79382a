"""DuckDB SQL for every registered report (the correctness oracle).

Each statement first derives the voucher star schema from the TPC-H-style
views with the FIXTURES.md §2 rules (``STAR_CTES``), narrows it to what the
§2.1, independent of the Spark plans it checks.
"""

from __future__ import annotations

STAR_CTES = """
voucher_types AS (SELECT * FROM (VALUES (1, 'SINV'), (2, 'RCT')) AS t(id, code)),
vouchers AS (
  SELECT o_orderkey AS id,
         'V' || CAST(o_orderkey AS VARCHAR) AS voucher_number,
         2 AS organization_id,
         CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS voucher_type_id,
         o_custkey AS party_id,
         CAST(o_orderkey % 5 AS INTEGER) AS site_id,
         CAST(o_orderdate AS DATE) AS transaction_date,
         o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS created_at,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         CASE o_orderstatus
           WHEN 'O' THEN CAST(o_totalprice AS DECIMAL(18,2))
           WHEN 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 50000 AS DECIMAL(18,2))
           ELSE CAST(0 AS DECIMAL(18,2)) END AS amount_due,
         CASE o_orderstatus WHEN 'O' THEN 'Unpaid' WHEN 'P' THEN 'Partially Paid' WHEN 'F' THEN 'Paid' END
           AS payment_status,
         CASE o_orderkey % 6 WHEN 1 THEN 'Packed' WHEN 2 THEN 'in_transit' WHEN 3 THEN 'Delivered'
           WHEN 4 THEN 'partially_delivered' WHEN 5 THEN 'pending' END AS delivery_status,
         (o_orderkey % 37 = 0) AS is_cancelled
  FROM orders),
parties AS (
  SELECT c.c_custkey AS id, 2 AS organization_id, CAST(n.n_regionkey AS INTEGER) AS site_id,
         c.c_name AS name,
         CASE WHEN c.c_custkey % 4 = 0 THEN '' ELSE '+' || CAST(c.c_custkey AS VARCHAR) END AS phone,
         CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE CAST(c.c_nationkey AS VARCHAR) END AS geo_location,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2
           WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 END AS party_group_id,
         CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_custkey % 10 END AS responsible_party_id,
         f.first_order + to_minutes(CAST(c.c_custkey % 1440 AS BIGINT)) AS created_at
  FROM customer c
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
    ON f.o_custkey = c.c_custkey),
party_groups AS (SELECT * FROM (VALUES (1, 'BUILDING'), (2, 'AUTOMOBILE'), (3, 'FURNITURE'), (4, 'HOUSEHOLD'))
                 AS t(id, name)),
sites AS (SELECT r_regionkey AS id, r_name AS name FROM region),
items AS (SELECT p_partkey AS id, p_name AS name FROM part),
users AS (SELECT s_suppkey AS id, s_name AS full_name FROM supplier),
voucher_items AS (
  SELECT l_orderkey AS voucher_id, l_partkey AS item_id, CAST(l_quantity AS DECIMAL(18,3)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount
  FROM lineitem),
delivery_challans AS (
  SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS related_invoice_voucher_id
  FROM lineitem),
document_status_history AS (
  SELECT l_orderkey * 10 + l_linenumber AS document_id,
         CASE l_returnflag WHEN 'A' THEN 'Packed' WHEN 'N' THEN 'in_transit' WHEN 'R' THEN 'Delivered' END
           AS new_status,
         l_shipdate + to_minutes(CAST(l_suppkey % 1440 AS BIGINT)) AS changed_at,
         l_suppkey AS changed_by
  FROM lineitem)
"""


# What the reports have in common: the organisation's documents at the report
# sites, those not cancelled, the sales invoices among them, and one row per
# invoice for the first time and first known actor of each delivery stage.
SCOPE_CTES = """
documents_ AS (
  SELECT v.*, k.code FROM vouchers v, voucher_types k
  WHERE k.id = v.voucher_type_id AND v.organization_id = 2),
scoped AS (SELECT * FROM vouchers WHERE organization_id = 2 AND site_id IN (1, 4)),
booked AS (SELECT * FROM documents_ WHERE site_id IN (1, 4) AND NOT is_cancelled),
invoices AS (SELECT * FROM booked WHERE code = 'SINV'),
receipts AS (SELECT * FROM booked WHERE code = 'RCT'),
staged AS (
  SELECT c.related_invoice_voucher_id AS invoice, h.changed_at AS since, u.id IS NOT NULL AS known, u.full_name AS who,
         CASE lower(h.new_status) WHEN 'packed' THEN 'P' WHEN 'shipped' THEN 'S' WHEN 'in_transit' THEN 'S'
              WHEN 'delivered' THEN 'D' WHEN 'fully_delivered' THEN 'D' WHEN 'partially_delivered' THEN 'D' END AS stage
  FROM document_status_history h
  JOIN delivery_challans c ON c.id = h.document_id
  LEFT JOIN users u ON u.id = h.changed_by),
milestones_ AS (
  SELECT invoice, min(since) FILTER (WHERE stage = 'P') AS packed_at, min(since) FILTER (WHERE stage = 'S') AS shipped_at,
         min(since) FILTER (WHERE stage = 'D') AS delivered_at,
         (list({'n': who} ORDER BY since NULLS LAST, who NULLS LAST) FILTER (WHERE stage = 'S' AND known))[1].n AS shipped_by,
         (list({'n': who} ORDER BY since NULLS LAST, who NULLS LAST) FILTER (WHERE stage = 'D' AND known))[1].n AS delivered_by
  FROM staged WHERE stage IS NOT NULL GROUP BY invoice)
"""


def with_star(body: str) -> str:
    """Prefix ``body`` (which may start with more CTEs after a comma) with
    the star-schema and scope CTEs."""
    body, ctes = body.strip(), STAR_CTES.strip() + ",\n" + SCOPE_CTES.strip()
    return "WITH " + ctes + ("" if body.startswith(",") else "\n") + body
