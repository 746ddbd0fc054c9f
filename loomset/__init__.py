"""loomset: build fine-tuning datasets from chat exports, message logs and notes with Spark.

Entry points: :func:`build_dataset` (read, judge, redact, assemble, format,
write, report) and :func:`read_samples` (the ``SAMPLES`` DataFrame of one
source kind). The building blocks live in ``functions`` (column builders),
``sources`` (readers and the JSONL sink), ``operators`` (DataFrame steps),
``plans`` (end-to-end job, registered queries, SQL oracle) and ``streaming``.
"""

from loomset.plans.dataset import build_dataset, read_samples
from loomset.session import local_session

__all__ = ["build_dataset", "read_samples", "local_session"]
