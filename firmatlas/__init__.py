"""Company-page analytics as Spark jobs: pages in, explainable company tables out."""

__version__ = "0.1.0"
