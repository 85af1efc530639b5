"""Row types."""

from pyspark.sql import types as T

ERROR = T.StructType().add("kind", "string").add("detail", "string")
#: A fetched page. page_id orders the pages of a run.
RAW_PAGE = T.StructType().add("page_id", "long").add("requested_url", "string").add("final_url", "string").add("status", "integer").add("html", "string").add("content_type", "string").add("error", ERROR)
#: A transformed page.
PAGE = T.StructType().add("page_id", "long").add("url", "string").add("title", "string").add("markdown", "string").add("tokens", "long").add("links", T.ArrayType(T.StringType()))
#: What a run reports while it goes.
EVENT = T.StructType().add("kind", "string").add("total", "long").add("url", "string").add("error", "string").add("ts", "timestamp")
#: Kinds of errors that rows carry.
HTTP, PARSE, IO, NO_CONTENT, ROBOTS, TOO_LARGE = "Http", "Parse", "Io", "NoContent", "Robots", "TooLarge"
