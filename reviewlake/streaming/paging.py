"""The paging bound on a stream of captured pages, in any order of arrival.

``page_bound_stream`` keeps per company which page is due next, the pages that came before their turn, and the stop
(``transformWithState``). A page leaves as soon as all pages before it are good; a bad page, a gap or the page
limit holds back what follows until a good capture of the missing page comes. Whatever the order of arrival
and the cut into micro-batches, the sink ends with the rows that the batch form gives:

    sink: PG.dedupe_captures(read(sink), prefer=[prefer])
    batch: PG.take_while_pages(PG.dedupe_captures(pages, prefer=[~bad, prefer]), bad)

State of a company: one counter and one entry for each of at most 99 pages, a held-back page with its content and a
page that has left with its ``prefer`` value and a hash only, so a better capture of it can still follow and a worse one does not.

``idle``: content held back by a company without captures for so long (in the time of ``captured``: a watermark) is dropped, and so are
captures that come later than that; what has left and the page that is due stay known. Captures without a time count as
captured now. Without it nothing is dropped.

Defined results: pages without a number, below 1 or from the limit on are ignored; a null company is one company; repeated
captures leave once; a null ``prefer`` is below any other; a null ``bad`` counts as good, as in the batch form; captures equal in ``prefer`` are ranked by their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewlake.sources.pages import PAGE_LIMIT

#: Transform-with-state needs this store; a session that has chosen another is left alone and told so by Spark.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = "spark.sql.streaming.stateStore.providerClass"


def _rank(prefer: int | None, content: str) -> tuple[int, str]:
    return (-(1 << 63) if prefer is None else prefer, hashlib.sha256(content.encode()).hexdigest())


class PageBound(StatefulProcessor):
    """Rows (company, page, prefer, content) that are not bad, in; those within the bound, out."""

    def __init__(self, idle: bool):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "page int")
        # content is null once a page has left
        self.pages = handle.getMapState("pages", "page int", "prefer long, digest string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else 1
        out, best, seen = [], {}, 0
        for pdf in rows:
            if self.idle:
                seen = max(seen, int(pdf["seen"].max().timestamp() * 1000))
            for page, prefer, content in zip(pdf["page"].tolist(), pdf["prefer"].tolist(), pdf["content"].tolist()):
                prefer = None if prefer is None or pd.isna(prefer) else int(prefer)
                rank = _rank(prefer, content)
                if page not in best or rank > best[page][0]:
                    best[page] = (rank, content)
        for page in sorted(best):
            rank, content = best[page]
            held = self.pages.getValue((page,)) if self.pages.containsKey((page,)) else None
            if held is not None and (held[0], held[1]) >= rank:
                if page < due or held[2] is not None or (held[0], held[1]) > rank:
                    continue
            if page < due:  # a better capture of a page that has left
                out.append((page, *rank, content))
                content = None
            self.pages.updateValue((page,), (*rank, content))
        while due < PAGE_LIMIT and self.pages.containsKey((due,)):
            prefer, digest, content = self.pages.getValue((due,))
            if content is None:  # dropped while the company was silent
                break
            out.append((due, prefer, digest, content))
            self.pages.updateValue((due,), (prefer, digest, None))
            due += 1
        self.due.update((due,))
        if self.idle:  # the watermark runs behind by the idle time: the timer is the last capture
            before = list(self.handle.listTimers())
            for t in before:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max([seen, *before]))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else 1
        for (page,) in list(self.pages.keys()):
            if page >= due:
                self.pages.removeKey((page,))
        yield self._rows(key, [])

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"company": pd.Series([key[0]] * len(out), dtype=object), "page": pd.Series([r[0] for r in out], dtype="int32"),
                             "content": pd.Series([r[3] for r in out], dtype=object)})

    def close(self) -> None:
        pass


def page_bound_stream(pages: DataFrame, bad: Column, prefer: str | None = None, company: str = "company", page: str = "page",
                      captured: str | None = None, idle: str | None = None) -> DataFrame:
    """The good pages of a stream that come before their company's first stop, all columns kept; a page leaves again when a
    capture with a greater ``prefer`` (an integer column or timestamp) comes later. Output mode: append."""
    spark = pages.sparkSession
    if spark.conf.get(_CONF, None) is None or spark.conf.get(_CONF).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_CONF, STATE_STORE)
    order = F.lit(None).cast("long")
    if prefer is not None:
        kind = pages.schema[prefer].dataType
        order = F.unix_micros(F.col(prefer).cast("timestamp")) if isinstance(kind, (Ty.TimestampType, Ty.TimestampNTZType, Ty.DateType)) else F.col(prefer).cast("long")
    number = F.col(page).cast("int")
    good = pages.where((number >= 1) & (number < PAGE_LIMIT) & F.coalesce(~bad, F.lit(True)))
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in pages.columns]), {"ignoreNullFields": "false"})
    rows = good.select(F.col(company).cast("string").alias("company"), number.alias("page"), order.alias("prefer"), content.alias("content"),
                       F.coalesce(F.col(captured).cast("timestamp") if captured else F.lit(None), F.current_timestamp()).alias("seen"))
    rows = rows.drop("seen") if idle is None else rows.withWatermark("seen", idle)
    out = rows.groupBy("company").transformWithStateInPandas(
        PageBound(idle is not None), outputStructType="company string, page int, content string", outputMode="Append",
        timeMode="None" if idle is None else "EventTime")
    return out.select(F.from_json("content", pages.schema).alias("_c")).select("_c.*")
