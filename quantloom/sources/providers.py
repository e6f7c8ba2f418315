"""Provider protocol, field mapping, retries and complete paging.

Network connectors cannot run offline; they plug in as a ``Provider``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_date, normalize_stock_code, to_bool
from ..schemas import dataset
from . import mock

# Provider field names.
FIELD_MAP = {"ts_code": "stock_code", "name": "stock_name", "vol": "volume", "up_limit": "limit_up", "down_limit": "limit_down", "end_date": "report_period", "ann_date": "announce_date"}
NAMES = ("mock", "akshare", "baostock", "tushare")


class Provider(Protocol):
    def fetch(self, name: str, day: str) -> list[dict]:
        """Raw rows of a dataset on a day."""


class MockProvider:
    """Raw rows as a provider would send them: its own names, compact dates."""

    def fetch(self, name: str, day: str) -> list[dict]:
        back = {v: k for k, v in FIELD_MAP.items() if k != "end_date" or name == "financial"}
        compact = lambda c, v: v.replace("-", "") if isinstance(v, str) and c.endswith("_date") else v
        return [{back.get(c, c): compact(c, v) for c, v in r.items()} for r in mock.rows(name, day)]


class CapabilityError(RuntimeError):
    """The provider does not offer a dataset."""


def make_provider(name: str, enabled: dict[str, Callable[[], Provider]] | None = None) -> Provider:
    """A provider by name; all but the mock one are off unless the caller passes a factory."""
    if name not in NAMES:
        raise ValueError(f"unknown provider: {name}")
    if name == "mock":
        return MockProvider()
    if name not in (enabled or {}):
        raise CapabilityError(f"provider {name} is not enabled")
    return enabled[name]()


def retry(call: Callable, attempts: int = 3, wait: float = 2.0, permanent: tuple = (CapabilityError, PermissionError), sleep=time.sleep):
    """Call again after a failure, but not after a permanent one."""
    for n in range(attempts):
        try:
            return call()
        except permanent:
            raise
        except Exception:
            if n + 1 == attempts:
                raise
            sleep(wait)


def map_frame(spark: SparkSession, raw: list[dict], name: str) -> DataFrame:
    """Provider rows as a conforming frame: names mapped, dates and codes normalised, further fields dropped."""
    spec = dataset(name)
    mapping = {k: v for k, v in FIELD_MAP.items() if k not in spec.names or k == v}
    names = sorted({k for r in raw for k in r})
    target = {n: mapping.get(n, n) for n in names}
    missing = [c for c in spec.names if c not in target.values()]
    if missing:
        raise ValueError(f"{name}: missing columns: {', '.join(missing)}")
    text = spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in raw], ", ".join(f"`{n}` string" for n in names))
    text = text.select(*[F.col(n).alias(t) for n, t in target.items() if t in spec.names])
    kinds = dict(spec.columns)

    def typed(c: str):
        if c == "stock_code":
            return normalize_stock_code(c)
        if c.endswith("_date") or c == "report_period":
            return normalize_date(c)
        if kinds[c] == "b":
            return to_bool(c)
        return F.when(~F.lower(c).isin("nan", ""), F.col(c)).try_cast("double") if kinds[c] == "f" else F.col(c).cast("long") if kinds[c] == "i" else F.col(c)

    return text.select(*[typed(c).alias(c) for c in spec.names])


@dataclass(frozen=True)
class PagingProof:
    pages: int
    rows: int
    complete: bool


def each_page(fetch: Callable[[int, int], list[dict]], keys: list[str], size: int = 5000, most: int | None = None) -> Iterator[list[dict]]:
    """Pages up to a short one, which alone says that the set is whole, however many there are; ``most`` makes more pages an error.

    A provider that begins again is stopped: no page may begin with a key that another page began with.
    """
    first, last, n = set(), None, 0
    while most is None or n < most:
        page = fetch(n * size, size)
        if page and page == last:
            raise ValueError("the provider sent a page twice")
        key = tuple(page[0][k] for k in keys) if page else None
        if key in first:
            raise ValueError(f"pages overlap at {key}")
        first.add(key)
        yield page
        if len(page) < size:
            return
        last, n = page, n + 1
    raise ValueError(f"no short page within {most} pages: the set is not complete")


def fetch_all_pages(fetch: Callable[[int, int], list[dict]], keys: list[str], size: int = 5000, most: int | None = None) -> tuple[list[dict], PagingProof]:
    """All pages up to a short one; a page or a key that comes twice is an error."""
    rows, seen, pages = [], set(), 0
    for page in each_page(fetch, keys, size, most):
        for r in page:
            key = tuple(r[k] for k in keys)
            if key in seen:
                raise ValueError(f"pages overlap at {key}")
            seen.add(key)
        rows += page
        pages += 1
    return rows, PagingProof(pages, len(rows), True)


#: Rows of pages that the driver holds before they go to a file.
LANDED_ROWS = 200_000


def land_all_pages(spark: SparkSession, fetch: Callable[[int, int], list[dict]], keys: list[str], schema: str, path: str, size: int = 5000, most: int | None = None) -> tuple[DataFrame, PagingProof]:
    """``fetch_all_pages`` for sets that the driver need not hold: pages go to files at ``path``, and a key that comes twice is found over the files."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema)
    arrow, held, pages = to_arrow_schema(kinds), [], 0

    def land():
        spark.createDataFrame(pa.Table.from_pylist(held, arrow), kinds).write.mode("append").parquet(path)
        held.clear()

    for page in each_page(fetch, keys, size, most):
        held += page
        pages += 1
        if len(held) >= LANDED_ROWS:
            land()
    land()
    rows = spark.read.schema(kinds).parquet(path)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.sum("__n").alias("rows"), F.max(F.when(F.col("__n") > 1, F.struct(*keys))).alias("twice")).first()
    if found["twice"] is not None:
        raise ValueError(f"pages overlap at {tuple(found['twice'])}")
    return rows, PagingProof(pages, found["rows"] or 0, True)


def probe(provider: Provider, wanted: dict[str, list[str]], day: str) -> Iterator[dict]:
    """For each dataset whether the provider answers and which fields it lacks."""
    for name, fields in wanted.items():
        try:
            raw = provider.fetch(name, day)
            have = {FIELD_MAP.get(k, k) for r in raw for k in r} | {k for r in raw for k in r}
            missing = [f for f in fields if f not in have]
            # rows of a provider are candidates at best; whether they may be promoted is for audits to say
            yield {"dataset": name, "reachable": True, "rows": len(raw), "missing": missing, "level": "DQ1" if raw else "DQ0"}
        except Exception as e:
            yield {"dataset": name, "reachable": False, "rows": 0, "missing": list(fields), "level": "DQ0", "error": type(e).__name__}
