"""docflow: bulk document enrichment as Spark DataFrame operators."""

from docflow.session import configure

__all__ = ["configure"]
