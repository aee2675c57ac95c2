"""Segmentation of streams: whole documents without state, and chunked documents with the open tail as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanmill.plans import segmenter


def segment_stream(documents: DataFrame) -> DataFrame:
    """Sentence spans of a stream of whole documents; the plan is narrow, so the batch function is the streaming one."""
    return segmenter.sentences(documents)


def last_break(text: str) -> int:
    """End of the last mark that the segmenter takes for a break and that no later text can change, or 0.

    A mark is judged by what follows it, so one with nothing but blanks behind is still open.
    """
    end = len(text.rstrip(segmenter.T.BLANKS))
    at = max(text.rfind(mark, 0, end) for mark in ".!?")
    while at >= 0:
        after = text[at + 1 :].lstrip(segmenter.T.BLANKS)[:1] if text[at + 1 : at + 2] in segmenter.T.BLANKS else text[at + 1 : at + 2]
        if after and segmenter.is_break(text[max(0, at - 4) : at], text[at + 1 : at + 2], after):
            return at + 1
        at = max(text.rfind(mark, 0, at) for mark in ".!?")
    return 0


class Reassemble(StatefulProcessor):
    """Holds back what stands behind the last break of a document and puts it before its next chunk.

    Chunks ``(doc_id, chunk, text, final)`` are numbered from 0 and may come in any
    order, in one batch or many: one that comes early waits for those before it.
    State is the open tail, an offset, the next number and the waiting chunks of each unfinished
    document; it goes when the final chunk was used. A document without a break is held whole, as its sentence is.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "tail string, offset long, next long")
        self.waiting = handle.getListState("waiting", "chunk long, text string, final boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        tail, offset, following = self.state.get() if self.state.exists() else ("", 0, 0)
        pending = {int(c): (text, final) for c, text, final in self.waiting.get()} if self.waiting.exists() else {}
        for frame in rows:
            pending |= {int(r.chunk): (r.text, bool(r.final)) for r in frame.itertuples() if int(r.chunk) >= following}
        out, done = [], False
        while not done and following in pending:
            text, done = pending.pop(following)
            tail, following = tail + (text or ""), following + 1
        cut = len(tail) if done else last_break(tail)
        if cut:
            out.append((key[0], offset, tail[:cut]))
        if done:
            self.state.clear()
            self.waiting.clear()
        else:
            self.state.update((tail[cut:], offset + cut, following))
            if pending:
                self.waiting.put([(c, text, final) for c, (text, final) in sorted(pending.items())])
            else:
                self.waiting.clear()
        yield pd.DataFrame(out, columns=["doc_id", "offset", "text"])

    def close(self) -> None:
        pass


def reassemble(chunks: DataFrame) -> DataFrame:
    """``(doc_id, offset, text)``: pieces that end at a break, from a stream (or a batch) of chunks."""
    return chunks.groupBy("doc_id").transformWithStateInPandas(Reassemble(), "doc_id long, offset long, text string", "Append", "None")


def chunked_sentences(chunks: DataFrame) -> DataFrame:
    """Sentences of chunked documents with offsets in the whole document."""
    pieces = reassemble(chunks).withColumnRenamed("doc_id", "of")
    found = segmenter.sentences(pieces.select(F.struct("of", "offset").alias("doc_id"), "text"))
    return found.select(F.col("doc_id.of").alias("doc_id"), (F.col("start") + F.col("doc_id.offset")).alias("start"), (F.col("end") + F.col("doc_id.offset")).alias("end"), "value")
