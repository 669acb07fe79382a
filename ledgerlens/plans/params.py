"""Report parameters: every constant the reports filter on, made explicit."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

# Fixed defaults: the operational values the reports were written for.
DEFAULT_ORG_ID = 2
DEFAULT_SITE_IDS = (1, 4)
DEFAULT_SITE_PIVOT = {"sales_site_1": 1, "sales_site_4": 4}
DEFAULT_TZ = "Asia/Kolkata"
DEFAULT_EXCLUDE_NAME_LIKE = "%emp%"
DEFAULT_CORPORATE_LIKE = "%corporate%"
SALES_INVOICE_CODE = "SINV"
RECEIPT_CODE = "RCT"


@dataclasses.dataclass(frozen=True)
class ReportParams:
    org_id: int = DEFAULT_ORG_ID
    site_ids: tuple[int, ...] = DEFAULT_SITE_IDS
    site_pivot: Mapping[str, int] = dataclasses.field(default_factory=lambda: dict(DEFAULT_SITE_PIVOT))
    tz: str = DEFAULT_TZ
    exclude_name_like: str = DEFAULT_EXCLUDE_NAME_LIKE
    corporate_like: str = DEFAULT_CORPORATE_LIKE
    # Group excluded from the customer-facing lists (at-risk, follow-up,
    # delivery board); a NULL group is dropped by these lists.
    excluded_group_id: int = 2
    # Groups left out of the salesman contribution / new customer lists; a
    # NULL group is kept there.
    salesman_excluded_group_ids: tuple[int, ...] = (2, 4)
    new_customer_excluded_group_ids: tuple[int, ...] = (4,)
    invoice_code: str = SALES_INVOICE_CODE
    receipt_code: str = RECEIPT_CODE


DEFAULT_PARAMS = ReportParams()
