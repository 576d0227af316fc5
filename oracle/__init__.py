"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each entry is one SQL string: the shared fixture roles as CTEs, the oracle's own
stage CTEs, then the key's final ``SELECT``. DuckDB evaluates only the CTEs a
query references.
"""

from __future__ import annotations

from vigia.sources.fixtures import oracle_ctes

from oracle import quality as _quality
from oracle import requests as _requests
from oracle import channel as _channel
from oracle import cleaning as _cleaning
from oracle import consent as _consent
from oracle import incidents as _incidents
from oracle import io as _io
from oracle import kri as _kri
from oracle import retention as _retention
from oracle import phone as _phone
from oracle import sales as _sales

_MODULES = [_quality, _sales, _kri, _phone, _incidents, _retention, _consent, _cleaning, _channel, _requests, _io]


def _compose(stages: dict[str, str], final: str) -> str:
    body = ",\n".join(f"{n} AS ({s})" for n, s in stages.items())
    return oracle_ctes() + (",\n" + body if body else "") + "\n" + final


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        for key, final in m.FINAL.items():
            out[key] = _compose(m.STAGES, final)
    return out
