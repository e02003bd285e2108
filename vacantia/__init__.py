"""vacantia: captured recruitment-site material in, clean and audited job-posting tables out, on Spark."""

__version__ = "0.1.0"
