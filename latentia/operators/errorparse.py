"""Loading delimited and tagged lines: rows that parse at no cost load, others get the cheapest repair as their reason.

One minimum-cost parse decides everything. Its edits are to insert or delete a quote, to insert or delete a delimiter,
and to accept a value that is not of its column's type; costs are compared in this order (one quote weighs more than any
number of delimiters, one delimiter more than any number of values). ``reason`` is the first kind of edit that the
cheapest parse needs, ``cost`` the number of its edits, ``fields`` are there if it needs none.

* Delimited lines: a best-first search over (symbol of the line, state of the quotes, column, state of the column's
  type). States of the quotes: start of a field, plain field, inside quotes, after a closing quote. Delimiters are
  edited in the columns only: a deleted one still ends what was quoted before it, an inserted one stands outside
  quotes, so that no such edit can stand for a missing quote. What the quotes still cost from a symbol on is computed
  backward first and guides the search, so that a line with few faults visits few states.
* Tagged lines: a dynamic program over the tokens with the state inside or outside quotation marks, whose steps carry
  the token's own cost in delimiters and values.

Lines that a plain predicate proves valid never leave the JVM; only the others are parsed in Python, in Arrow batches.

Defined cases: null lines are no rows; a line that is empty or only spaces and tabs is a valid boundary; repeated
lines each count; very long lines are parsed whole; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from latentia.session import ship

PARSED = "line_id long, fields array<string>, reason string, cost int, edits array<string>"
START, PLAIN, QUOTED, CLOSED = range(4)
_INF = 1 << 60
_BASE = 1 << 20  # a line has fewer symbols
REASONS = ("quoting", "columns", "value")


class Digits:
    """A type of column as an automaton over pieces of text; the state is None where nothing can help any more."""

    first = ""

    def after(self, state, text: str):
        return "0" if state is not None and text.isascii() and text.isdigit() else None

    def good(self, state) -> bool:
        return state == "0"


class Some(Digits):
    """Any text but the empty one."""

    def after(self, state, text: str):
        return "x"

    def good(self, state) -> bool:
        return state == "x"


class Anything(Some):
    def good(self, state) -> bool:
        return True


class OneOf(Digits):
    """One of a closed list of texts."""

    def __init__(self, texts: list[str]):
        self.texts = frozenset(texts)
        self.starts = frozenset(t[:k] for t in texts for k in range(len(t) + 1))

    def after(self, state, text: str):
        return state + text if state is not None and state + text in self.starts else None

    def good(self, state) -> bool:
        return state in self.texts


#: Types of the nine columns of an entity line.
NER_COLUMNS = (OneOf(["O", *(f"{b}-{t}" for b in "BI" for t in ("PER", "LOC", "ORG", "MISC"))]), Digits(), Digits(), Some(), Some(), Some(), Anything(), Anything(), Digits())


def _symbols(line: str, quote: str, delimiter: str) -> list[str]:
    """Quotes and delimiters singly, other characters in runs that end at blanks (where a delimiter may be missing)."""
    other = re.escape(quote + delimiter)
    return re.findall(f"{re.escape(quote)}|{re.escape(delimiter)}|[^{other} ]+| +", line)


def strict_fields(line: str, quote: str = '"', delimiter: str = "\t") -> list[str] | None:
    """Fields of a line that needs no quoting edit, else None."""
    if quote not in line:
        return line.split(delimiter)
    out, state, text = [], START, []
    for s in _symbols(line, quote, delimiter):
        if state == START and s == quote:
            state = QUOTED
        elif state == QUOTED and s == quote:
            state = CLOSED
        elif state == CLOSED and s == quote:  # two quotes are one
            text.append(quote)
            state = QUOTED
        elif state == CLOSED and s != delimiter:
            return None
        elif state != QUOTED and s == delimiter:
            out.append("".join(text))
            text, state = [], START
        else:
            text.append(s)
            if state != QUOTED:
                state = PLAIN
    if state == QUOTED:
        return None
    return [*out, "".join(text)]


def _step(state: int, s: str, quote: str, delimiter: str) -> int | None:
    if s == quote:
        return {START: QUOTED, PLAIN: PLAIN, QUOTED: CLOSED, CLOSED: QUOTED}[state]
    if s == delimiter:
        return QUOTED if state == QUOTED else START
    return None if state == CLOSED else QUOTED if state == QUOTED else PLAIN


def _quotes_ahead(symbols: list[str], quote: str, delimiter: str) -> list[list[int]]:
    """Least number of quotes to insert or delete from each symbol on, for each state of the quotes."""
    n = len(symbols)
    out = [[_INF] * 4 for _ in range(n + 1)]
    out[n] = [0, 0, 1, 0]
    for i in range(n - 1, -1, -1):
        s, ahead = symbols[i], out[i + 1]
        here = [ahead[to] if (to := _step(state, s, quote, delimiter)) is not None else _INF for state in range(4)]
        if s == quote:
            here = [min(h, ahead[state] + 1) for state, h in enumerate(here)]
        for _ in range(2):  # at most two inserted in a row: more would only undo one another
            here = [min(h, here[_step(state, quote, quote, delimiter)] + 1) for state, h in enumerate(here)]
        out[i] = here
    return out


def cheapest_parse(line: str, columns: tuple = NER_COLUMNS, quote: str = '"', delimiter: str = "\t") -> tuple[tuple[int, int, int], list[str]]:
    """Least number of edits of quotes, delimiters and values, in this order, and the edits."""
    symbols = _symbols(line, quote, delimiter)
    n, m = len(symbols), len(columns)
    ahead = _quotes_ahead(symbols, quote, delimiter)
    q1, c1 = _BASE * _BASE, _BASE
    first = (0, START, 0, columns[0].first)
    best = {first: 0}
    back: dict[tuple, tuple] = {}
    heap: list[tuple[int, int, int, tuple]] = [(ahead[0][START] * q1, 0, 0, first)]
    done = set()
    while heap:
        *_, state = heapq.heappop(heap)
        if state in done:
            continue
        done.add(state)
        i, quotes, j, kind = state
        cost = best[state]
        if i > n:
            break

        def go(to: tuple, more: int, edit: str | None) -> None:
            new = cost + more
            if new < best.get(to, _INF * _INF):
                best[to] = new
                back[to] = (state, edit)
                left = ahead[to[0]][to[1]] if to[0] <= n else 0
                heapq.heappush(heap, (new + left * q1, -to[0], len(back), to))  # of equal cost the one that has come farther

        end = 0 if columns[j].good(kind) else 1
        wrong = f"value of field {j}" if end else None
        if quotes != PLAIN and ahead[i][_step(quotes, quote, quote, delimiter)] < _INF:
            to = _step(quotes, quote, quote, delimiter)
            go((i, to, j, columns[j].after(kind, quote) if quotes == CLOSED else kind), q1, f"insert {quote} before symbol {i}")
        if (quotes in (START, PLAIN) or (quotes == CLOSED and i == n)) and j + 1 < m:  # a closing quote may yet be half of two
            go((i, quotes, j + 1, columns[j + 1].first), c1 + end, f"insert delimiter before symbol {i}" + (f"; {wrong}" if wrong else ""))
        if i == n:
            if quotes != QUOTED and j == m - 1:
                go((n + 1, START, j, None), end, wrong)
            continue
        s = symbols[i]
        to = _step(quotes, s, quote, delimiter)
        if s == delimiter and quotes != QUOTED:
            if j + 1 < m:
                go((i + 1, START, j + 1, columns[j + 1].first), end, wrong)
            go((i + 1, START, j, kind), c1, f"delete delimiter at symbol {i}")
        elif to is not None:
            content = s != quote or quotes in (PLAIN, CLOSED)
            go((i + 1, to, j, columns[j].after(kind, s) if content else kind), 0, None)
        if s == quote:
            go((i + 1, quotes, j, kind), q1, f"delete {quote} at symbol {i}")
    edits = []
    total = best[state]
    while state in back:
        state, edit = back[state]
        if edit:
            edits += reversed(edit.split("; "))
    return (total // q1, total % q1 // c1, total % c1), edits[::-1]


def _reason(cost: tuple[int, int, int]) -> str | None:
    return next((r for r, c in zip(REASONS, cost) if c), None)


def parse_delimited(line: str, columns: tuple = NER_COLUMNS) -> tuple[list[str] | None, str | None, int, list[str]]:
    """Fields if the line is valid, else the reason, the number of edits and the edits."""
    (q, c, v), edits = cheapest_parse(line, columns)
    if not line.isascii():
        v, edits = v + 1, [*edits, "not ASCII"]
    reason = _reason((q, c, v))
    return (None, reason, q + c + v, edits) if reason else (strict_fields(line), None, 0, [])


def _token(token: str, tags: frozenset[str]) -> tuple[int, int, str | None]:
    """Delimiters and values to edit in a token, and what."""
    word, slash, tag = token.rpartition("/")
    if slash:
        bad = not word or tag not in tags
        return 0, int(bad), "value" if bad else None
    fits = any(token[k:] in tags for k in range(1, len(token)))
    return 1, int(not fits), "insert delimiter" if fits else "insert delimiter; value"


def parse_tagged(line: str, tags: frozenset[str]) -> tuple[list[str] | None, str | None, int, list[str]]:
    """Tokens ``word/tag`` of a tagged line if it is valid, else the reason, the number of edits and the edits.

    Opening and closing marks alternate, opening first, closing last; a mark may be deleted, or its partner inserted.
    """
    tokens = [t for t in line.split(" ") if t]
    q1, c1 = _BASE * _BASE, _BASE
    cost, trail = [0, _INF * _INF], []  # outside, inside
    for t in tokens:
        word, slash, _ = t.rpartition("/")
        mark = ("``", "''").index(word) if slash and word in ("``", "''") else None
        c, v, _ = _token(t, tags)
        own = c * c1 + v
        new, step = [_INF * _INF] * 2, [("", 0)] * 2
        for state in (0, 1):
            if mark is None:
                moves = [(state, own, "keep")]
            elif mark == state:
                moves = [(1 - state, own, "keep"), (state, q1, "delete quote")]
            else:
                moves = [(state, q1, "delete quote"), (state, q1 + own, "insert quote before")]
            for to, more, op in moves:
                if cost[state] + more < new[to]:
                    new[to], step[to] = cost[state] + more, (op, state)
        cost = new
        trail.append(step)
    state = 0 if cost[0] <= cost[1] + q1 else 1
    total, edits = min(cost[0], cost[1] + q1), ["insert quote at end"] if state else []
    for i in range(len(tokens) - 1, -1, -1):
        op, state = trail[i][state]
        what = _token(tokens[i], tags)[2] if op != "delete quote" else None
        edits += [f"{x} of token {i}" for x in reversed([*([op] if op != "keep" else []), *(what.split("; ") if what else [])])]
    found = (total // q1, total % q1 // c1, total % c1)
    reason = _reason(found)
    return (None, reason, sum(found), edits[::-1]) if reason else (tokens, None, 0, [])


def _run(parse: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *parse(t)) for i, t in zip(batch.column("line_id").to_pylist(), batch.column("line").to_pylist())]
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["line_id", "fields", "reason", "cost", "edits"])

    return run


def boundary(line: Column) -> Column:
    return line.rlike(r"\A[ \t]*\z")


def plainly_valid_delimited(line: Column) -> Column:
    """True only for lines that are valid: no quote at all, nine fields, all of their types."""
    f = F.split(line, "\t", -1)
    digits = lambda i: f[i].rlike(r"\A[0-9]+\z")
    return (
        ~line.contains('"') & (F.size(f) == 9) & f[0].rlike(r"\A(?:O|[BI]-(?:PER|LOC|ORG|MISC))\z") & digits(1) & digits(2)
        & (f[3] != "") & (f[4] != "") & (f[5] != "") & digits(8) & (F.length(line) == F.octet_length(line))
    )


def plainly_valid_tagged(line: Column, tags: list[str]) -> Column:
    """True only for lines that are valid: no quote marks, every token with a word and an allowed tag."""
    tokens = F.filter(F.split(line, " +"), lambda t: t != "")
    allowed = F.array(*[F.lit(t) for t in tags])
    ok = F.forall(tokens, lambda t: t.contains("/") & (F.substring_index(t, "/", -1) != t) & (F.length(t) > F.length(F.substring_index(t, "/", -1)) + 1) & F.array_contains(allowed, F.substring_index(t, "/", -1)))
    return ~line.contains("``") & ~line.contains("''") & ok


def parse_ner_lines(df: DataFrame, line_id: str, line: str, failing_only: bool = False) -> DataFrame:
    """``line_id, fields, reason, cost, edits`` of every non-boundary line; ``fields`` null where it fails."""
    ship(df.sparkSession)
    rows = df.select(F.col(line_id).cast("long").alias("line_id"), F.col(line).alias("line")).where(F.col("line").isNotNull() & ~boundary(F.col("line")))
    good = F.coalesce(plainly_valid_delimited(F.col("line")), F.lit(False))
    parsed = rows.where(~good).mapInArrow(_run(parse_delimited), PARSED)
    if failing_only:
        return parsed.where("reason is not null")
    return rows.where(good).select("line_id", F.split("line", "\t", -1).alias("fields"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("cost"), F.array().cast("array<string>").alias("edits")).unionByName(parsed)


def parse_tagged_lines(df: DataFrame, line_id: str, line: str, tags: list[str], failing_only: bool = False) -> DataFrame:
    """The same for ``word/tag`` lines; ``tags``: the tag set, a closed list."""
    ship(df.sparkSession)
    allowed = sorted({t for t in tags if t is not None})
    rows = df.select(F.col(line_id).cast("long").alias("line_id"), F.col(line).alias("line")).where(F.col("line").isNotNull() & ~boundary(F.col("line")))
    good = F.coalesce(plainly_valid_tagged(F.col("line"), allowed), F.lit(False))
    held = frozenset(allowed)
    parsed = rows.where(~good).mapInArrow(_run(lambda t: parse_tagged(t, held)), PARSED)
    if failing_only:
        return parsed.where("reason is not null")
    return rows.where(good).select("line_id", F.filter(F.split("line", " +"), lambda t: t != "").alias("fields"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("cost"), F.array().cast("array<string>").alias("edits")).unionByName(parsed)
