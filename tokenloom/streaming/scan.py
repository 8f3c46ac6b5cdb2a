"""Incremental scanning: the matches of a stream are those of its whole text, however it is cut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.lexer import lex
from ..plans.pattern import Input, Pattern, PatternError
from ..shipping import ship


class Scanner:
    """Push chunks, get the matches that no later text can change; ``finish`` gives the rest.

    Whole lines are lexed, as no token crosses a line's end. A start is decided
    once its search has ended without asking for a token beyond the text so
    far; matching stops before the first undecided start and goes on from there
    with the next chunk. Text is forgotten up to the line of the token before
    that start, or as far back as the pattern's look-behinds reach; a pattern
    with tests of recurrence, order or nesting remembers all of it. A pattern
    such as ``.*``, which any text may lengthen, gives nothing before the end.
    """

    def __init__(self, pattern: str, buffer: str = "", base: int = 0, at: int = 0, contiguous: bool = True, begun: bool = True) -> None:
        self.pattern = Pattern(pattern)
        if self.pattern.joins:
            raise PatternError("a stream can't be joined with another input")
        self.buffer, self.base, self.at, self.contiguous, self.begun = buffer, base, at, contiguous, begun
        self.decided = base

    @property
    def state(self) -> tuple[str, int, int, bool, bool]:
        return self.buffer, self.base, self.at, self.contiguous, self.begun

    def push(self, chunk: str) -> list[tuple[int, int, str]]:
        self.buffer += chunk
        return self._commit(self.buffer[: self.buffer.rfind("\n") + 1], True) if "\n" in chunk else []

    def finish(self) -> list[tuple[int, int, str]]:
        return self._commit(self.buffer, False)

    def _commit(self, text: str, more: bool) -> list[tuple[int, int, str]]:
        tokens = lex(text)
        ctx = Input(text, tokens)
        ctx.open, ctx.begun, ctx.origin = more, self.begun, self.at if self.contiguous else -1
        out = [(self.base + tokens[a].start, self.base + tokens[e - 1].end, text[tokens[a].start : tokens[e - 1].end]) for a, e, _ in self.pattern.spans(ctx, None, self.at)]
        at = ctx.at
        self.contiguous = ctx.origin == at
        #: Characters whose matches are all given.
        self.decided = self.base + (tokens[at].start if at < len(tokens) else len(text))
        keep = None if self.pattern.past is None else max(0, at - 1 - self.pattern.past)
        if keep is None or not tokens or keep >= len(tokens):
            cut = 0
        else:
            cut = text.rfind("\n", 0, tokens[keep].start) + 1
        gone = sum(t.start < cut for t in tokens)
        self.buffer, self.base, self.at = self.buffer[cut:], self.base + cut, at - gone
        self.begun = self.begun and gone == 0
        return out


class SetScanner:
    """Several patterns over one stream: matches come with their member, by (start, end, member) within a push."""

    def __init__(self, patterns: dict[str, str]) -> None:
        self.members = {n: Scanner(p) for n, p in patterns.items()}

    def push(self, chunk: str) -> list[tuple[int, int, str, str]]:
        return sorted((a, b, n, t) for n, s in self.members.items() for a, b, t in s.push(chunk))

    def finish(self) -> list[tuple[int, int, str, str]]:
        return sorted((a, b, n, t) for n, s in self.members.items() for a, b, t in s.finish())


class Editor:
    """Rewrites a stream: text leaves as soon as no later text can change its matches; ``how`` gives a match's new text."""

    def __init__(self, pattern: str, how) -> None:
        self.scanner, self.how, self.held, self.base = Scanner(pattern), how, "", 0

    def _emit(self, found: list[tuple[int, int, str]], upto: int) -> str:
        out, at = [], self.base
        for a, b, t in found:
            out += [self.held[at - self.base : a - self.base], self.how(t)]
            at = b
        out.append(self.held[at - self.base : max(at, upto) - self.base])
        at = max(at, upto)
        self.held, self.base = self.held[at - self.base :], at
        return "".join(out)

    def push(self, chunk: str) -> str:
        self.held += chunk
        found = self.scanner.push(chunk)
        return self._emit(found, self.scanner.decided)

    def finish(self) -> str:
        return self._emit(self.scanner.finish(), self.base + len(self.held))


def scan(stream: DataFrame, pattern: str, stream_id: str = "stream_id", seq: str = "seq", chunk: str = "chunk", last: str | None = None) -> DataFrame:
    """(stream_id, start, end, text) of a streaming DataFrame of chunks; state is the undecided text.

    ``last`` names a boolean column that is true for a stream's last chunk,
    whose arrival gives the matches that waited for more.
    """
    ship(stream.sparkSession)
    Scanner(pattern)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Scanner(pattern, *(state.get if state.exists else ()))
        rows = pd.concat(list(frames)).sort_values("seq")
        found = []
        for c, end in zip(rows["chunk"], rows["last"], strict=True):
            found += s.push(c or "")
            if end:
                found += s.finish()
                s = Scanner(pattern)
        state.update(s.state)
        yield pd.DataFrame({"stream_id": [key[0]] * len(found), "start": [m[0] for m in found], "end": [m[1] for m in found], "text": [m[2] for m in found]})

    named = stream.select(F.col(stream_id).cast("string").alias("stream_id"), F.col(seq).alias("seq"), F.col(chunk).alias("chunk"), (F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)).alias("last"))
    return named.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, start long, end long, text string", "buffer string, base long, at int, contiguous boolean, begun boolean", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window with a watermark, for batch and streaming frames alike."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), key, "n", "total")
