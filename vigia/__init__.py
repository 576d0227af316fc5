"""vigia — call-centre sales-quality and risk analytics on Spark.

Every operator is a pure ``DataFrame -> DataFrame`` function parameterised by a
:class:`vigia.params.Period`; pipelines in :mod:`vigia.plans` compose them and
only :mod:`vigia.sources` / :mod:`vigia.operators.sinks` touch storage.
"""

from vigia.params import Period

__all__ = ["Period"]
