"""Documents that arrive in parts: pages wait in keyed state until their document is whole, or until no more are waited for.

A page carries the number of pages of its document. State holds the pages of open documents and, for a while, the ids of closed ones, so that pages that come late or
twice change nothing. Time is event time: once the watermark passes a document's last page by ``wait``, the document is closed as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "numbers array<int>, texts array<string>, total int, closed boolean, latest bigint"


def page_documents(pages: DataFrame, wait: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """doc_id, text, n_pages, complete: each document once, when its last missing page has come or its time is over.

    ``pages`` is a stream of doc_id, page (from 1), total (pages of the document), text and ``arrived`` (its event time). The text is that of
    ``readers.join_pages``: non-empty pages in order, after their numbers. Of a page that comes twice the first text counts. Pages without a document or number are left out.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()

    def close(key: tuple, numbers: list, texts: list, total: int) -> pd.DataFrame:
        text = "".join(f"[Page {n}] {t}\n\n" for n, t in sorted(zip(numbers, texts)) if t)
        return pd.DataFrame({"doc_id": [key[0]], "text": [text], "n_pages": [len(numbers)], "complete": [len(numbers) >= total]})

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts, total, closed, latest = state.get if state.exists else ([], [], 0, False, 0)
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield close(key, numbers, texts, total)
            return
        held = dict(zip(numbers, texts))
        for frame in frames:
            latest = max(latest, int(frame["arrived"].max().timestamp() * 1000))
            total = max(total, int(frame["total"].max()))
            if not closed:
                for number, text in zip(frame["page"].tolist(), frame["text"].tolist()):
                    held.setdefault(int(number), text or "")
        if not closed and len(held) >= total:
            yield close(key, list(held), list(held.values()), total)
            closed, held = True, {}
        state.update((list(held), list(held.values()), total, closed, latest))
        state.setTimeoutTimestamp(max(latest + wait_ms, state.getCurrentWatermarkMs() + 1))

    usable = pages.where("doc_id is not null and page is not null and total is not null and arrived is not null")
    grouped = usable.withWatermark("arrived", wait).groupBy("doc_id")
    return grouped.applyInPandasWithState(update, f"doc_id {kind}, text string, n_pages int, complete boolean", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
