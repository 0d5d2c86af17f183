"""Paged sources: where a list goes on, when it ends, and what is an error. Calls are rows, pages are read in order.

How a list goes on is told by its pages: a cursor in ``next``, else an offset; a reported total ends it, as does an empty
page, and a short one where no total is known. A page without a list, a cursor that comes again and too many pages are errors,
and there is no partial result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that report a collection's total.
TOTALS = ["total"]


class PageError(RuntimeError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def item_list(page: Any, key: str | None) -> tuple[str, list]:
    """(key, items) of a page: the list of a known key, else ``items`` or the first list but errors."""
    if not isinstance(page, dict):
        raise PageError("INVALID_PAGINATION_RESPONSE", f"a page is {type(page).__name__}, not an object")
    if key is None:
        lists = [k for k, v in page.items() if isinstance(v, list) and k != "errors"]
        if not lists:
            raise PageError("ITEM_ARRAY_NOT_FOUND", f"no list among {sorted(page)}")
        key = "items" if "items" in lists else lists[0]
    if not isinstance(page.get(key), list):
        raise PageError("INVALID_ITEM_ARRAY", f"{key} is no list")
    return key, page[key]


def _total(page: dict, totals: Sequence[str], before: int) -> int:
    told = next((page[k] for k in totals if page.get(k) is not None), None)
    try:
        return int(told) if told is not None and int(told) > 0 else before
    except (TypeError, ValueError):
        return before


def collect(fetch: Callable[[dict[str, str]], Any], most: int = 50, size: int = 100, key: str | None = None, style: str = "auto", totals: Sequence[str] = TOTALS, start: int = 0) -> list:
    """All items of a paged list, read with fetch(parameters)."""
    got: list = []
    total, seen, params = 0, set(), {"limit": str(size), **({"offset": str(start)} if start else {})}
    for _ in range(most):
        page = fetch(params)
        key, items = item_list(page, key)
        got += items
        total = _total(page, totals, total)
        if not items or total and len(got) >= total:
            return got
        if style == "auto":
            offset = total or "offset" in page or "next" not in page
            style = "cursor" if page.get("next") is not None or not offset else "offset"
        if style == "offset":
            if not total and len(items) < size:
                return got
            params = {"limit": str(size), "offset": str(start + len(got))}
            continue
        cursor = "" if page.get("next") is None else str(page["next"])
        if not cursor:
            return got
        if cursor in seen:
            raise PageError("PAGINATION_LOOP", f"the cursor {cursor!r} came again")
        seen.add(cursor)
        params = {"limit": str(size), "next": cursor}
    raise PageError("PAGINATION_TRUNCATED", f"{most} pages gave {len(got)} of {total or 'an unknown number of'} items")


def collected(pages: DataFrame, most: int = 50, size: int = 100, cap_bytes: int | None = None) -> DataFrame:
    """(call_id, n_items, code) of recorded pages (call_id, page from 0, body as JSON text) of many calls.

    A call's pages, at most ``most`` and one, are read in order as collect asks for them; code is that of an error, or ''. With
    a cap, a result whose JSON is over so many bytes is RESULT_TOO_LARGE, and no part of it is given."""
    kind = pages.schema["call_id"].dataType.simpleString()

    def one(bodies) -> tuple[int, str]:
        left = iter(bodies)
        try:
            items = collect(lambda params: json.loads(next(left)), most, size)
        except PageError as e:
            return 0, e.code
        except (StopIteration, TypeError, ValueError):
            return 0, "PAGE_NOT_READ"
        large = cap_bytes is not None and len(json.dumps(items, separators=(",", ":")).encode()) > cap_bytes
        return (0, "RESULT_TOO_LARGE") if large else (len(items), "")

    def work(frames):
        import pandas as pd

        for frame in frames:
            got = [one(bodies) for bodies in frame["bodies"]]
            yield pd.DataFrame({"call_id": frame["call_id"], "n_items": [g[0] for g in got], "code": [g[1] for g in got]})

    calls = pages.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]).alias("bodies"))
    return calls.mapInPandas(work, f"call_id {kind}, n_items int, code string")
