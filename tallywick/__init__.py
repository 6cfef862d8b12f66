"""Customer analytics over an order table, as Spark DataFrame operations."""

from .contract import IngestError
from .operators.clv import ClvResult, compute_clv
from .operators.cohorts import CohortResult, compute_cohorts
from .operators.lists import CustomerLists, build_customer_lists
from .operators.quality import QualityReport, check_orders
from .operators.segments import RfmResult, build_advice, compute_rfm
from .sources.ingest import IngestResult, load_orders

__version__ = "0.1.0"
__all__ = ["ClvResult", "CohortResult", "CustomerLists", "IngestError", "IngestResult", "QualityReport", "RfmResult", "build_advice", "build_customer_lists", "check_orders", "compute_clv", "compute_cohorts", "compute_rfm", "load_orders"]
