"""Quality month: manual evaluations + speech analytics → final note.

``QualityInputs`` names the input tables; each stage property returns a lazy
DataFrame. The tables the reference keeps physically (manual detail, marked
calls, speech detail before and after the curve, patched detail) are
materialised with a reliable checkpoint: later stages read them several times
(self-joins of whole-group sums, the patch's donor/zero lookups), and cutting
the lineage there keeps plans small and lets a lost executor recompute from the
checkpoint instead of from the raw feeds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from vigia.operators import consolidation as C
from vigia.operators import quality_manual as QM
from vigia.operators import speech as S
from vigia.params import Period
from vigia.session import cut_lineage

SALE_PRODUCTS = ("SEG", "PA", "UPG", "TCA", "IL", "RCO", "RTC", "CD", "CHIP", "EC", "BNC", "BNB", "CON", "PP", "TC")

#: Columns of the manual detail that the notes and the patch read.
MANUAL_SCORE_COLUMNS = ("PERIODO", "CODIGO", "REG_EJECUTIVO", "NUM_EVALUACION", "PESO_PREGUNTA_OBT")


@dataclass
class QualityInputs:
    evals: DataFrame
    syn_group: DataFrame
    syn_question: DataFrame
    syn_answer: DataFrame
    qmaster: DataFrame
    speech: DataFrame
    speech_master: DataFrame
    sales: DataFrame
    leads: DataFrame
    leads_digital: DataFrame
    agents: DataFrame
    history: DataFrame
    metrics: tuple[str, ...]


class QualityMonth:
    def __init__(self, inp: QualityInputs, period: Period):
        self.i = inp
        self.p = period

    # manual evaluations
    @cached_property
    def normalised(self) -> DataFrame:
        return QM.eval_normalise(self.i.evals)

    @cached_property
    def mapped(self) -> DataFrame:
        return QM.eval_homologate(self.normalised, self.i.syn_group, self.i.syn_question, self.i.syn_answer)

    @cached_property
    def scored(self) -> DataFrame:
        return QM.eval_scored(self.mapped, self.p)

    @cached_property
    def weighted(self) -> DataFrame:
        return QM.eval_weights(self.scored, QM.master_homologated(self.i.qmaster, self.i.syn_group,
                                                                  self.i.syn_question))

    @cached_property
    def penalised(self) -> DataFrame:
        return QM.eval_critical_penalty(self.weighted)

    @cached_property
    def manual_detail(self) -> DataFrame:
        return cut_lineage(QM.eval_detail(self.i.evals, self.i.syn_group, self.i.syn_question, self.i.syn_answer,
                              self.i.qmaster, self.p))

    @cached_property
    def manual_scores(self) -> DataFrame:
        """What the notes and the patch read of the manual detail: stored without its texts and dates."""
        detail = self.__dict__.get("manual_detail")
        if detail is None:
            detail = QM.eval_detail(self.i.evals, self.i.syn_group, self.i.syn_question, self.i.syn_answer, self.i.qmaster, self.p)
            return cut_lineage(detail.select(*MANUAL_SCORE_COLUMNS))
        return detail.select(*MANUAL_SCORE_COLUMNS)

    # speech analytics
    @cached_property
    def speech_clean(self) -> DataFrame:
        return S.speech_phone_clean(self.i.speech)

    @cached_property
    def consent(self) -> DataFrame:
        return S.consent_dedup(self.i.leads, self.i.leads_digital)

    @cached_property
    def mark_all(self) -> DataFrame:
        return S.sale_mark_priority(self.speech_clean, S.sale_hits(self.i.sales, self.p),
                                    S.consent_by_document(self.consent))

    @cached_property
    def marked_packed(self) -> DataFrame:
        return S.speech_marked(self.i.speech, self.i.sales, self.i.leads, self.i.leads_digital, self.p, self.i.metrics)

    @cached_property
    def marked(self) -> DataFrame:
        return S.unpack_metrics(self.marked_packed, self.i.metrics)

    @cached_property
    def averages(self) -> DataFrame:
        return S.speech_averages(self.marked_packed, self.p)

    @cached_property
    def average(self) -> DataFrame:
        return S.speech_average(self.averages, self.i.metrics)

    @cached_property
    def unpivoted(self) -> DataFrame:
        return S.speech_unpivot(self.averages, self.i.metrics)

    @cached_property
    def sa_weighted(self) -> DataFrame:
        return S.speech_weights(self.unpivoted, self.i.speech_master)

    @cached_property
    def sa_detail_scores(self) -> DataFrame:
        return S.speech_score_detail(self.sa_weighted)

    @cached_property
    def sa_group_scores(self) -> DataFrame:
        # Read twice (rows and their groups' factors), so the averages of all calls are stored first.
        return cut_lineage(S.speech_score_group(cut_lineage(self.sa_detail_scores)).select(*S.DETAIL_SA_COLUMNS))

    @cached_property
    def sa_curved(self) -> DataFrame:
        return S.speech_curve_cap(self.sa_group_scores, self.i.agents, apply_cap=False)

    @cached_property
    def sa_capped(self) -> DataFrame:
        return cut_lineage(S.speech_curve_cap(self.sa_group_scores, self.i.agents))

    @cached_property
    def sa_patched(self) -> DataFrame:
        return cut_lineage(S.zero_score_patch(self.sa_capped, self.i.agents, self.manual_scores, self.p))

    # consolidation
    @cached_property
    def pc_note(self) -> DataFrame:
        return C.manual_note(self.manual_scores)

    @cached_property
    def sa_note(self) -> DataFrame:
        return C.speech_note(self.sa_patched)

    @cached_property
    def final(self) -> DataFrame:
        return C.final_note(self.pc_note, self.sa_note, self.i.agents, self.i.history, self.p)

    @cached_property
    def errors(self) -> DataFrame:
        return C.error_history(self.manual_detail, self.p)
