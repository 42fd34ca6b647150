"""JSON-RPC frames inside captured send buffers (base64)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame patterns.
_CALL = r'"method"\s*:\s*"tools/call"'
_NAME = r'"name"\s*:\s*"([^"]+)"'
_USE_ID = r'claudecode/toolUseId"\s*:\s*"([^"]+)"'


def frame(buf: Column) -> Column:
    """Decoded text; NULL for a missing or broken buffer."""
    return F.try_to_binary(buf, F.lit("base64")).cast("string")


def is_request(text: Column) -> Column:
    return F.coalesce(text.contains('"method"') & text.contains('"jsonrpc"'), F.lit(False))


def is_reply(text: Column, *, loose: bool = False) -> Column:
    """A frame with an id.  ``loose`` also counts requests as replies."""
    has = text.contains('"jsonrpc"') & text.contains('"id"')
    if not loose:
        has = has & ~text.contains('"method"')
    return F.coalesce(has, F.lit(False))


def call_name(text: Column) -> Column:
    """Tool name of a tools/call frame; NULL for any other frame."""
    name = F.regexp_extract(text, _NAME, 1)
    return F.when(text.rlike(_CALL) & (F.length(name) > 0), name)


def call_use_id(text: Column) -> Column:
    """Use id carried by a tools/call frame; '' when it carries none."""
    return F.when(call_name(text).isNotNull(), F.regexp_extract(text, _USE_ID, 1))
