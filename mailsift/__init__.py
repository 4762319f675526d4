"""mailsift: email cleaning, scoring and triage as Spark DataFrame jobs."""

__version__ = "0.1.0"
