"""Run parameters: the month being processed and the business cut-offs."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Period:
    """One monthly run.

    ``periodo`` is ``YYYYMM`` text. Half-month windows come from the business
    configuration (days 1-14 and 15-31 by default). ``run_ts`` replaces
    ``CURRENT_TIMESTAMP``/``CURRENT_DATE`` so results are reproducible.
    """

    periodo: str
    corte_dia_inicio_1: int = 1
    corte_dia_fin_1: int = 14
    corte_dia_inicio_2: int = 15
    corte_dia_fin_2: int = 31
    run_ts: _dt.datetime = field(default=_dt.datetime(2000, 4, 1, 8, 0, 0))
    hist_from: str | None = None   # first management-history period kept

    @property
    def anio(self) -> int:
        return int(self.periodo[:4])

    @property
    def mes(self) -> int:
        return int(self.periodo[4:])

    @property
    def periodo_num(self) -> int:
        return int(self.periodo)

    @property
    def fec_inicio_mes(self) -> _dt.date:
        return _dt.date(self.anio, self.mes, 1)

    @property
    def fec_fin_mes(self) -> _dt.date:
        nxt = _dt.date(self.anio + (self.mes == 12), self.mes % 12 + 1, 1)
        return nxt - _dt.timedelta(days=1)

    @property
    def periodo_prev(self) -> str:
        y, m = (self.anio, self.mes - 1) if self.mes > 1 else (self.anio - 1, 12)
        return f"{y:04d}{m:02d}"

    @property
    def fec_inicio_mes_sig(self) -> _dt.date:
        return self.fec_fin_mes + _dt.timedelta(days=1)

    @property
    def run_date(self) -> _dt.date:
        return self.run_ts.date()

    @property
    def history_from(self) -> str:
        return self.hist_from or self.periodo_prev


def run_timestamp(period: Period):
    """The run's wall-clock stamp as a TIMESTAMP_NTZ literal, independent of the session time zone."""
    from pyspark.sql import functions as F
    return F.lit(period.run_ts.isoformat(sep=" ")).cast("timestamp_ntz")
