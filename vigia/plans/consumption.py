"""Consumption month: product marts → risk indicators (sales without audio, phones).

The marts, the unified batch traffic and the back-filled platform traffic are
the tables the reference stores between scripts; each is read by several later
steps, so they are materialised once with a reliable checkpoint (lineage cut,
executor-loss safe) instead of being recomputed inside every consumer's plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from vigia.operators import kri_audio as KA
from vigia.operators import kri_phone as KP
from vigia.operators import sales as SA
from vigia.params import Period
from vigia.session import cut_lineage


@dataclass
class ConsumptionInputs:
    feeds: dict[str, DataFrame]          # raw product feeds by name (TC, PP, EC, CD, CON, UPG, IL, PA, SEG)
    debt_lines: DataFrame
    agents: DataFrame
    leads: DataFrame
    leads_digital: DataFrame
    registry: DataFrame
    traffic_batch: DataFrame
    traffic_platform: DataFrame
    traffic_derived: DataFrame
    extra_sales: dict[str, DataFrame] | None = None   # products no mart builds (additional cards)
    campaigns: DataFrame | None = None
    ivr: DataFrame | None = None
    evaluated: DataFrame | None = None


class StoredMarts(Mapping):
    """Marts by product, each written when it is first read: a query stores only what it uses."""

    def __init__(self, plans: dict[str, DataFrame]):
        self.plans, self.stored = plans, {}

    def __getitem__(self, product: str) -> DataFrame:
        if product not in self.stored:
            self.stored[product] = cut_lineage(self.plans[product], f"mart-{product}")
        return self.stored[product]

    def __iter__(self):
        return iter(self.plans)

    def __len__(self) -> int:
        return len(self.plans)


class ConsumptionMonth:
    def __init__(self, inp: ConsumptionInputs, period: Period):
        self.i = inp
        self.p = period

    @cached_property
    def marts(self) -> Mapping[str, DataFrame]:
        f, a, p = self.i.feeds, self.i.agents, self.p
        marts = {
            "TC": SA.sales_card(f["TC"], f["SEG"], a, p),
            "PP": SA.sales_loan(f["PP"], a, p),
            "EC": SA.sales_cash_line(f["EC"], a, p),
            "CD": SA.sales_debt_purchase(f["CD"], self.i.debt_lines, a, p),
            "CON": SA.sales_agreement(f["CON"], a, p),
            "UPG": SA.sales_upgrade(f["UPG"], a, p),
            "IL": SA.sales_line_increase(f["IL"], a, p),
            "PA": SA.sales_autopay(f["PA"], a, p),
            "SEG": SA.sales_insurance(f["SEG"], a, p),
        }
        return StoredMarts(marts)

    @cached_property
    def kri_sales(self) -> DataFrame:
        return KA.sales_union_kri(self.marts, self.p)

    @cached_property
    def platform_typed(self) -> DataFrame:
        return KA.traffic_agent_type(self.i.traffic_platform, self.i.agents)

    @cached_property
    def platform_doc(self) -> DataFrame:
        return KA.traffic_backfill_document(self.platform_typed, self.i.leads, self.i.leads_digital)

    @cached_property
    def platform_final(self) -> DataFrame:
        return cut_lineage(KA.traffic_backfill_registry(self.platform_doc, self.i.registry))

    @cached_property
    def batch_unified(self) -> DataFrame:
        return KA.traffic_unify(self.i.traffic_batch, self.i.agents, self.i.leads, self.i.leads_digital,
                                self.i.registry, self.p)

    @cached_property
    def batch_traffic(self) -> DataFrame:
        return cut_lineage(KA.traffic_drop_blank(self.batch_unified))

    @cached_property
    def sales_origin(self) -> DataFrame:
        return KA.sale_call_origin(self.kri_sales, self.batch_traffic)

    def kri_no_audio(self, shape: str = "management") -> DataFrame:
        return KA.kri_sales_no_audio(self.sales_origin, self.i.agents, self.p, shape)

    # ---------------------------------------------------------------- phones
    @cached_property
    def phone_sales(self) -> DataFrame:
        extra = self.i.extra_sales or {}
        marts = {p.product: extra[p.product] if p.product in extra else self.marts[p.product] for p in KP.PHONE_PRODUCTS}
        return cut_lineage(KP.product_sales(marts))

    @cached_property
    def talk_time(self) -> DataFrame:
        src = KP.traffic_sources(self.batch_traffic, self.platform_final, self.i.traffic_derived)
        return KP.phone_talk_time(self.phone_sales, src)

    @cached_property
    def longest(self) -> DataFrame:
        return cut_lineage(KP.phone_longest(self.talk_time))

    @cached_property
    def authorised(self) -> DataFrame:
        return KP.phone_authorisation(self.longest, self.i.registry, self.i.leads, self.i.campaigns, self.p)

    @cached_property
    def with_amount(self) -> DataFrame:
        return KP.sale_amount_attach(self.authorised, self.phone_sales)

    @cached_property
    def phones_all(self) -> DataFrame:
        return KP.phone_union_all(self.with_amount)

    @cached_property
    def phones_flagged(self) -> DataFrame:
        return KP.phone_flags(self.phones_all, self.marts, self.i.ivr, self.i.evaluated)

    @cached_property
    def kri_phone_nominal(self) -> DataFrame:
        return KP.kri_phone_nominal(self.phones_flagged, self.p)

    @cached_property
    def kri_phone_quality(self) -> DataFrame:
        return KP.kri_phone_quality(self.phones_flagged, self.i.agents)
