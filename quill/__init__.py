"""quill: text analytics as Spark DataFrame and Structured Streaming operators.

Every operator is a function ``DataFrame(s) -> DataFrame``.  Nothing here
collects data to the driver or creates a session; callers own the session
(see :mod:`quill.session`).
"""

__version__ = "0.1.0"
