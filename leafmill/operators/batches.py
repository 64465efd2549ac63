"""Tables of many pages at once: whole documents in Arrow batches, each step over the numbers of all their spans.

A step that goes from one value to the next (leaders, spacing) is done for all pages side by side, a value of each page a
round. Groups are numbered from 0 and stand in order; a group's members are a run, given by its start and count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..options import ANCHOR_CLUSTER, ANCHOR_SHARE, COLUMN_SPACING, GAP_CLUSTER, HEADER_BYTES, MAX_ANCHORS, SAME_HEADER, TUNE_MERGE_GAPS, TUNE_ROW_GAPS, WRAP_REACH, TableOpts

SPANS_AT_ONCE = 200_000  # of whole documents; a longer document is taken alone
GRID = tuple((m, r) for m in TUNE_MERGE_GAPS for r in TUNE_ROW_GAPS)


@dataclass(frozen=True)
class Limits:
    """The numbers of TableOpts; chosen: nothing is filtered later, so that the kernel can number and choose itself."""

    y_tol: float
    wrap_tol: float
    least: int
    gap_over: float
    merge_gap: float
    max_row_gap: float
    tune: bool
    chosen: bool
    names: tuple[str, ...] | None = None  # in lower case; instead of columns and cells, the cells under these headers

    @staticmethod
    def of(opts: TableOpts, tune: bool = False, names: tuple[str, ...] | None = None) -> Limits:
        chosen = opts.row_filter is None and not opts.require_any_column and not opts.anchor_column
        return Limits(opts.y_tol, opts.wrap_tol, opts.columns_at_least, opts.gap_over, float(opts.merge_gap), float(opts.max_row_gap), tune, chosen, names)


# Groups


def changes(values: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def codes(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def count_of(groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, minlength=n)


def cross(groups: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each element i with every member j of its group, in order."""
    n = count[groups]
    i = np.repeat(np.arange(len(groups)), n)
    return i, np.arange(len(i)) + np.repeat(start[groups] - starts_of(n), n)


def offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(counts)), pa.int32())


def joined_texts(text: pa.Array, counts: np.ndarray) -> pa.Array:
    """Runs of texts, each joined by spaces."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets(counts), text), " ")


def view(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts."""
    offs = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    data = text.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offs


NUMERIC = np.isin(np.arange(256), list(b"0123456789.,- "))


def with_words(text: pa.Array) -> np.ndarray:
    """Which texts have a character that is none of digits, points, commas, hyphens and spaces."""
    data, offs = view(text)
    other = np.append(0, np.cumsum(~NUMERIC[data[offs[0] : offs[-1]]]))
    return np.diff(other[offs - offs[0]]) > 0


def without_edges(text: pa.Array) -> np.ndarray:
    """Which texts begin and end with a visible ASCII character."""
    data, offs = view(text)
    full = np.diff(offs) > 0
    first, last = data[offs[:-1][full]], data[offs[1:][full] - 1]
    full[full] = (first > 32) & (first < 127) & (last > 32) & (last < 127)
    return full


def so_far(flag: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """True from the first flag of a group on."""
    total = np.cumsum(flag)
    before = (total - flag)[changes(groups)]
    return total - before[np.cumsum(changes(groups)) - 1] > 0


def leaders(groups: np.ndarray, v: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): a value joins the first leader of its group that is nearer than the tolerance, or becomes a leader;
    at: where each leader stands."""
    which, at, todo, n = np.empty(len(v), np.int64), [], np.arange(len(v)), 0
    while len(todo):
        first = changes(groups[todo])
        lead, own = todo[first], np.cumsum(first) - 1
        with np.errstate(invalid="ignore"):
            near = first | (np.abs(v[todo] - v[lead][own]) < tolerance)
        which[todo[near]] = n + own[near]
        at.append(lead)
        n += len(lead)
        todo = todo[~near]
    return which, np.concatenate(at) if at else np.empty(0, np.int64)


def spaced(groups: np.ndarray, x: np.ndarray, spacing: float = COLUMN_SPACING) -> np.ndarray:
    """Which values, in order of x in each group, stand at least spacing from the last one kept."""
    keep, todo = np.zeros(len(x), bool), np.arange(len(x))
    while len(todo):
        first = changes(groups[todo])
        keep[todo[first]] = True
        with np.errstate(invalid="ignore"):
            near = first | (x[todo] - x[todo[first]][np.cumsum(first) - 1] < spacing)
        todo = todo[~near]
    return keep


@dataclass
class Clusters:
    """Clusters by group and x; pairs: (cluster, row), once each."""

    group: np.ndarray
    x: np.ndarray
    support: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(groups: np.ndarray, v: np.ndarray, row: np.ndarray, tolerance: float, n_rows: int) -> Clusters:
        which, at = leaders(groups, v, tolerance)
        order = np.lexsort((v[at], groups[at]))
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        pairs = row * len(at) + place[which]
        if not (pairs[1:] >= pairs[:-1]).all():
            pairs.sort()
        pairs = pairs[changes(pairs)]
        cluster = pairs % max(len(at), 1)
        return Clusters(groups[at][order], v[at][order], count_of(cluster, len(at)), (cluster, pairs // max(len(at), 1)))


def zones(column_x: np.ndarray, start: np.ndarray, count: np.ndarray, groups: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, column): for each anchor the first column of its group in its zone, which ends half way to the next
    anchors; anchors without one are left out."""
    half, same = (x[1:] + x[:-1]) / 2, groups[1:] == groups[:-1]
    lo = np.append(-np.inf, np.where(same, half, -np.inf))[: len(x)]
    hi = np.append(np.where(same, half, np.inf), np.inf)[: len(x)]
    a, c = cross(groups, start, count)
    inside = (column_x[c] >= lo[a]) & (column_x[c] < hi[a])
    a, c = a[inside], c[inside]
    first = changes(a)
    return a[first], c[first]


def taken(column: pa.Array, at: np.ndarray) -> pa.Array:
    """column.take, but for nothing where all stands so already."""
    return column if len(at) == len(column) and (at == np.arange(len(at))).all() else column.take(pa.array(at))


def contained(texts: pa.Array, i: np.ndarray, wanted: pa.Array, j: np.ndarray) -> np.ndarray:
    """Whether text i holds wanted text j, for each pair."""
    code = codes(wanted)[j]
    order = np.argsort(code, kind="stable")
    cut = np.append(np.flatnonzero(changes(code[order])), len(order))
    out = np.zeros(len(i), bool)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = order[a:b]
        out[own] = pc.match_substring(texts.take(pa.array(i[own])), wanted[int(j[own[0]])].as_py()).to_numpy(zero_copy_only=False)
    return out


# Sheets


class Sheets:
    """Spans of whole documents as rows of pages: spans by page, row and x; rows from the top down."""

    def __init__(self, t: pa.Table, y_tol: float):
        col = {n: t[n].combine_chunks() for n in t.column_names}
        num = {n: pc.cast(col[n], pa.float64()).to_numpy(zero_copy_only=False) for n in ("x", "y", "end_x", "font_size")}
        seq = col["span_seq"].to_numpy(zero_copy_only=False)
        new_doc = changes(codes(col["doc_id"]))
        new_page = new_doc | changes(codes(col["page"]))
        page, head = np.cumsum(new_page) - 1, np.flatnonzero(new_page)
        self.page_doc = (np.cumsum(new_doc) - 1)[head]
        self.n_docs, self.n_pages = int(new_doc.sum()), len(head)
        self.doc_id, self.page_no = col["doc_id"].take(pa.array(np.flatnonzero(new_doc))), col["page"].take(pa.array(head))
        # content order
        step = (page[1:] > page[:-1]) | (seq[1:] > seq[:-1])
        every = [seq, num["y"], num["x"], num["end_x"], num["font_size"]]
        order = np.arange(len(seq)) if step.all() else ordered(col["text"], [page, *every])
        x, y = num["x"][order], num["y"][order]
        which, at = leaders(page, y, y_tol)
        down = np.lexsort((at, x[at], -y[at], page[at]))
        place = np.empty(len(at), np.int64)
        place[down] = np.arange(len(at))
        row = place[which]
        self.row_page, self.y = page[at][down], y[at][down]
        self.n_rows = len(at)
        by_x = np.lexsort((x, row))
        if ((row[by_x][1:] == row[by_x][:-1]) & (x[by_x][1:] == x[by_x][:-1])).any():
            by_x = ordered(col["text"].take(pa.array(order)), [row, x, seq[order], num["end_x"][order], num["font_size"][order]])
        at = order[by_x]
        self.row, self.x, self.end_x, self.size = row[by_x], num["x"][at], num["end_x"][at], num["font_size"][at]
        self.text = taken(col["text"], at)
        self.low = pc.coalesce(taken(col["low"], at), self.text)
        self.page_rows = count_of(self.row_page, self.n_pages)
        self.row_spans = count_of(self.row, self.n_rows)
        self.row_start = starts_of(self.row_spans)
        self.row_doc = self.page_doc[self.row_page]
        self.one_word = ~pc.match_substring(self.text, " ").to_numpy(zero_copy_only=False)
        self.bytes = pc.binary_length(self.text).to_numpy(zero_copy_only=False)
        self.words = with_words(self.text)

    def follows(self, last: pa.Scalar | None) -> bool:
        """Whether documents, after the one that was last before, and the pages of each stand in order and come once."""
        docs = self.doc_id if last is None else pa.concat_arrays([pa.array([last.as_py()], self.doc_id.type), self.doc_id])
        p = pc.fill_null(pc.cast(self.page_no, pa.int64()), np.iinfo(np.int64).min).to_numpy()
        rising = not docs[1:].null_count and pc.all(pc.less(docs[:-1], docs[1:]), min_count=0).as_py()
        return rising and bool(((p[1:] > p[:-1]) | (self.page_doc[1:] > self.page_doc[:-1])).all())

    def headings(self) -> np.ndarray:
        """Which spans could be headers: short and no numbers."""
        return self.words & (self.bytes >= 1) & (self.bytes <= HEADER_BYTES)

    def spans_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k, span): the spans of each of the rows, k its number among them."""
        return cross(rows, self.row_start, self.row_spans)

    def lowest(self, pages: np.ndarray, last: np.ndarray, heads: np.ndarray, lim: Limits) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, on): where the headers of the pages end, and the rows that are wrapped under them; heads: how many
        headers have no space."""
        low, unfinished = np.full(self.n_pages, np.nan), np.zeros(self.n_pages, np.int64)
        end = np.full(self.n_pages, self.n_rows)
        low[pages], unfinished[pages], end[pages] = self.y[last], heads, last
        below = np.flatnonzero(np.arange(self.n_rows) > end[self.row_page]) if lim.wrap_tol > 0 else np.empty(0, np.int64)
        page, single = self.row_page[below], count_of(self.row[self.one_word], self.n_rows)[below]
        down = low[page] - self.y[below]
        fits = (down >= lim.y_tol) & (down <= lim.wrap_tol) & (single > 0) & (single <= unfinished[page])
        on = below[~so_far(~fits, page)] if len(below) else below
        np.minimum.at(low, self.row_page[on], self.y[on])
        return low, on


def ordered(text: pa.Array, keys: list[np.ndarray]) -> np.ndarray:
    rank = pc.rank(text, tiebreaker="dense").to_numpy(zero_copy_only=False)
    return np.lexsort((rank, *keys[::-1]))


def without_twins(groups: np.ndarray, x: np.ndarray, text: pa.Array) -> np.ndarray:
    """Which elements have no kept earlier one of their group with their text within a point."""
    keep, code = np.ones(len(x), bool), codes(text)
    order = np.lexsort((code, groups))
    twice = (groups[order][1:] == groups[order][:-1]) & (code[order][1:] == code[order][:-1])
    kept: dict[tuple, list[float]] = {}
    for i in np.flatnonzero(np.isin(groups, groups[order][1:][twice])):
        before = kept.setdefault((groups[i], code[i]), [])
        keep[i] = not any(abs(v - x[i]) < SAME_HEADER for v in before)
        if keep[i]:
            before.append(x[i])
    return keep


@dataclass
class Columns:
    """The columns of each table."""

    start: np.ndarray
    count: np.ndarray
    x: np.ndarray
    names: pa.Array

    @staticmethod
    def of(tables: np.ndarray, x: np.ndarray, names: pa.Array, n: int) -> Columns:
        count = count_of(tables, n)
        return Columns(starts_of(count), count, x, names)

    def named(self, low: pa.Array, name: str) -> np.ndarray:
        """The first column of a name in each table, -1 where it has none; low: the names in lower case."""
        out, at = np.full(len(self.count), -1), np.flatnonzero(pc.equal(low, name).to_numpy(zero_copy_only=False))
        table = np.repeat(np.arange(len(self.count)), self.count)[at]
        at, table = at[changes(table)], table[changes(table)]
        out[table] = at - self.start[table]
        return out

    def array(self) -> pa.Array:
        return pa.ListArray.from_arrays(offsets(self.count), pa.StructArray.from_arrays([self.names, pa.array(self.x)], ["name", "x"]))


class Rows:
    """Rows of tables with the column of each of their spans. rows: of the sheets, in order; key: rows of one key may be
    merged and cut; table: its number in columns."""

    def __init__(self, s: Sheets, rows: np.ndarray, key: np.ndarray, table: np.ndarray, columns: Columns):
        self.s, self.rows, self.key, self.table, self.columns = s, rows, key, table, columns
        self.y, self.new = s.y[rows], changes(key)
        self.of_span, self.span = s.spans_of(rows)
        i, j = cross(table[self.of_span], columns.start, columns.count)
        far = np.abs(s.x[self.span[i]] - columns.x[j])
        far = np.where(np.isnan(far), np.inf, far)
        n = columns.count[table[self.of_span]]
        nearest = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, starts_of(n)), n)) if len(far) else np.empty(0, np.int64)
        nearest = nearest[changes(i[nearest])]
        self.column = j[nearest] - columns.start[table[self.of_span]]

    def merged(self, gap: np.ndarray | float, cut: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(to, first, kept): the merged row of each row, the first row of each merged one, and which of them stand before
        a cut; gaps of 0 are off."""
        gap, cut = np.broadcast_to(gap, self.y.shape), np.broadcast_to(cut, self.y.shape)
        above = np.append(np.nan, self.y[:-1])[: len(self.y)]
        apart = self.new | (gap <= 0) | (above - self.y >= gap)
        to, first = np.cumsum(apart) - 1, np.flatnonzero(apart)
        bottom = self.y[np.append(first[1:], len(self.y))[: len(first)] - 1]
        far = ~self.new[first] & (cut[first] > 0) & (np.append(np.nan, bottom[:-1])[: len(first)] - self.y[first] > cut[first])
        return to, first, ~so_far(far, self.key[first]) if len(first) else far

    def cells(self, to: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
        """The cells of the merged rows that are kept."""
        width = np.where(kept, self.columns.count[self.table[first]], 0)
        mine = np.flatnonzero(kept[to[self.of_span]])
        cell = starts_of(width)[to[self.of_span[mine]]] + self.column[mine]
        order = np.lexsort((self.s.x[self.span[mine]], cell))
        text = self.s.text.take(pa.array(self.span[mine][order]))
        return pa.ListArray.from_arrays(offsets(width[kept]), joined_texts(text, count_of(cell, int(width.sum()))))

    def cells_under(self, cells: pa.ListArray, own: np.ndarray, column: np.ndarray) -> pa.Array:
        """Of rows of cells, own in rows, those in a column of each table; empty where it is -1."""
        at = column[self.table[own]]
        place = cells.offsets.to_numpy()[:-1] + at
        return pc.fill_null(cells.values.take(pa.array(place, mask=at < 0)), "")

    def choices(self, group: np.ndarray, n: int) -> np.ndarray:
        """The number in GRID of the best table of each group: the logarithm of one more than the rows, times the square
        of the share of filled cells; the first of the best."""
        score, widest = np.full((n, len(GRID)), -np.inf), int(self.columns.count.max(initial=1))
        for g, (gap, cut) in enumerate(GRID):
            to, first, kept = self.merged(gap, cut)
            if cut == TUNE_ROW_GAPS[0]:
                filled = count_of(np.unique(to[self.of_span] * widest + self.column) // widest, len(first))
            own = group[first][kept]
            rows, full = count_of(own, n), np.bincount(own, filled[kept], n)
            cells = np.bincount(own, self.columns.count[self.table[first]][kept], n)
            has = rows > 0
            share = full[has] / cells[has]
            score[has, g] = np.log1p(rows[has]) * (share * share)
        return score.argmax(axis=1)


# Tables


def across(s: Sheets, lim: Limits) -> pa.Table:
    """One table a document, its headers found: see tables.across_pages."""
    docs, span_doc = s.n_docs, s.row_doc[s.row]
    # the row that looks most like a header
    h = np.flatnonzero(s.headings())
    h = h[spaced(s.row[h], s.x[h])]
    many, size = count_of(s.row[h], s.n_rows), np.bincount(s.row[h], s.bytes[h], s.n_rows)
    rows = np.flatnonzero(many >= lim.least)
    rows = rows[np.lexsort((rows, size[rows], -many[rows], s.row_doc[rows]))]
    best = np.zeros(s.n_rows, bool)
    best[rows[changes(s.row_doc[rows])]] = True
    h = h[best[s.row[h]]]
    own = span_doc[h]
    n_own = count_of(own, docs)
    # its names on the starts that recur
    c = Clusters.of(span_doc, s.x, s.row, ANCHOR_CLUSTER, s.n_rows)
    rows_of = count_of(s.row_doc, docs)
    least = np.maximum(3, np.minimum(20, (rows_of * ANCHOR_SHARE).astype(np.int64)))
    a = np.flatnonzero((c.support >= least[c.group]) & (n_own[c.group] > 0))
    a = a[spaced(c.group[a], c.x[a])]
    found = count_of(c.group[a], docs)
    ranked = a[np.lexsort((c.x[a], -c.support[a], c.group[a]))]
    nth = np.arange(len(a)) - starts_of(found)[c.group[ranked]]
    a = np.sort(ranked[nth < n_own[c.group[ranked]]])
    a = a[count_of(c.group[a], docs)[c.group[a]] >= lim.least]
    anchored = count_of(c.group[a], docs) > 0
    za, zc = zones(s.x[h], starts_of(n_own), n_own, c.group[a], c.x[a])
    plain = np.flatnonzero(~anchored[own])
    table = np.concatenate([c.group[a][za], own[plain]])
    order = np.argsort(table, kind="stable")
    name_at = np.concatenate([h[zc], h[plain]])[order]
    at = np.concatenate([c.x[a][za], s.x[h[plain]]])[order]
    columns = Columns.of(table[order], at, s.text.take(pa.array(name_at)), docs)
    # where pages have these headers
    width = columns.count[s.row_doc]
    base = starts_of(width)
    texts = np.flatnonzero(s.words)  # a header has a character that numbers lack
    i, j = cross(span_doc[texts], columns.start, columns.count)
    i, low_names = texts[i], s.low.take(pa.array(name_at))
    size = pc.binary_length(s.low).to_numpy(zero_copy_only=False)
    fits = size[i] >= size[name_at][j]
    i, j = i[fits], j[fits]
    hit = contained(s.low, i, low_names, j)
    i, j = i[hit], j[hit]
    holds, named = np.zeros(int(width.sum()), bool), np.zeros(len(s.x), bool)
    holds[base[s.row[i]] + j - columns.start[span_doc[i]]] = True
    named[i] = True
    follows = np.append(s.row_page[1:] == s.row_page[:-1], False)[: s.n_rows]
    both, on = holds.copy(), np.flatnonzero(np.repeat(follows, width))
    both[on] |= holds[on + np.repeat(width, width)[on]]
    sums = lambda flag: np.diff(np.append(0, np.cumsum(flag))[np.append(base, len(flag))])
    one = np.flatnonzero((sums(holds) == width) & (width > 0))
    two = np.flatnonzero((sums(both) == width) & (width > 0) & follows)
    first, last = np.full(s.n_pages, -1), np.full(s.n_pages, -1)
    for place, more in ((two, 1), (one, 0)):
        place = place[changes(s.row_page[place])]
        first[s.row_page[place]], last[s.row_page[place]] = place, place + more
    pages = np.flatnonzero(first >= 0)
    f, e = first[pages], last[pages]
    k, span = s.spans_of(np.stack([f, e], 1).ravel())
    keep = (k % 2 == 0) & (f == e)[k // 2] | (f != e)[k // 2] & named[span]
    k, span = (k // 2)[keep], span[keep]
    keep = without_twins(k, s.x[span], s.text.take(pa.array(span))) & s.one_word[span]
    low, _ = s.lowest(pages, e, count_of(k[keep], len(pages)), lim)
    # rows of data, and rows above the header that continue the page before
    later = np.zeros(s.n_pages, bool)
    later[pages] = ~changes(s.page_doc[pages])
    row = np.arange(s.n_rows)
    placed, head, end = first[s.row_page] >= 0, first[s.row_page], last[s.row_page]
    data = placed & (row > end) & (s.y < low[s.row_page] - lim.y_tol)
    use = np.flatnonzero(data | (placed & later[s.row_page] & (row < head)))
    part = data[use].astype(np.int64)
    r = Rows(s, use, s.row_page[use] * 2 + part, s.row_doc[use], columns)
    names = None if lim.names is None else [columns.named(low_names, n) for n in lim.names]
    if lim.tune and lim.chosen:
        choice = r.choices(r.table, docs)
        gap, cut = (np.array(v)[choice][r.table] for v in zip(*GRID, strict=True))
        return spread_out(r, part, gap, cut, lim.chosen, names=names)
    if lim.tune:
        return pa.concat_tables([spread_out(r, part, g, c, False, n) for n, (g, c) in enumerate(GRID)])
    return spread_out(r, part, lim.merge_gap, lim.max_row_gap, lim.chosen, names=names)


def spread_out(r: Rows, part: np.ndarray, gap: np.ndarray | float, cut: np.ndarray | float, chosen: bool, grid: int = 0, names: list[np.ndarray] | None = None) -> pa.Table:
    s, (to, first, kept) = r.s, r.merged(gap, cut)
    own = first[kept]
    doc = r.table[own]
    number = np.arange(len(own))
    if chosen:
        number = number - np.flatnonzero(changes(doc))[np.cumsum(changes(doc)) - 1]
    page = s.row_page[r.rows[own]]
    out = {"doc_id": s.doc_id.take(pa.array(doc)), "page": s.page_no.take(pa.array(page)), "row_no": pa.array(number, pa.int32()), "y": pa.array(r.y[own])}
    cells = r.cells(to, first, kept)
    if names is None:
        out |= {"columns": r.columns.array().take(pa.array(doc)), "cells": cells}
    else:
        out |= {f"_{i}": r.cells_under(cells, own, column) for i, column in enumerate(names)}
    if not chosen:
        out |= {"part": pa.array(part[own], pa.int32()), "grid": pa.array(np.full(len(own), grid), pa.int32())}
    return pa.table(out)


def by_gaps(s: Sheets, lim: Limits) -> tuple[Rows, np.ndarray]:
    """(rows, island): of the tables whose rows share recurring gaps; island: of each table, in order on its page."""
    need = lim.least - 1
    a = np.flatnonzero((s.row[1:] == s.row[:-1]) & (s.page_rows[s.row_page[s.row[:-1]]] >= 2)) if len(s.row) else np.empty(0, np.int64)
    length = pc.utf8_length(s.text.take(pa.array(a))).to_numpy(zero_copy_only=False)
    end = np.where(s.end_x[a] > s.x[a], s.end_x[a], s.x[a] + length * s.size[a] * 0.5)
    wide = s.x[a + 1] - end > lim.gap_over
    a, middle = a[wide], ((end + s.x[a + 1]) / 2)[wide]
    c = Clusters.of(s.row_page[s.row[a]], middle, s.row[a], GAP_CLUSTER, s.n_rows)
    strong = c.support >= np.maximum(3, (s.page_rows / 4).astype(np.int64))[c.group]
    n_strong = count_of(c.group[strong], s.n_pages)
    shared = count_of(c.pairs[1][strong[c.pairs[0]]], s.n_rows)
    rows = np.flatnonzero((shared >= need) & (n_strong >= need)[s.row_page] & (s.page_rows >= 2)[s.row_page])
    new = changes(s.row_page[rows]) | changes(rows - np.arange(len(rows)))
    region = np.cumsum(new) - 1
    top = rows[new]
    # the first row of a region names its columns
    k, span = s.spans_of(top)
    gap_x = c.x[strong]
    i, j = cross(s.row_page[top[k]], starts_of(n_strong), n_strong)
    n = count_of(i[gap_x[j] < s.x[span[i]]], len(span))
    fresh = changes(k) | changes(n)
    names = joined_texts(s.text.take(pa.array(span)), np.diff(np.append(np.flatnonzero(fresh), len(span))))
    of, x = k[fresh], s.x[span[fresh]]
    good = (count_of(of, len(top)) >= 2) & (count_of(region, len(top)) >= 2)
    number = np.cumsum(good) - 1
    columns = Columns.of(number[of[good[of]]], x[good[of]], names.filter(pa.array(good[of])), int(good.sum()))
    data = good[region] & ~new
    table = number[region[data]]
    return Rows(s, rows[data], table, table, columns), np.flatnonzero(good)


def by_anchors(s: Sheets, lim: Limits, pages: np.ndarray) -> Rows:
    """Rows under the row that puts header-like texts on most of the page's recurring starts; pages: which to look at."""
    looked = np.flatnonzero(pages[s.row_page[s.row]] & (s.page_rows >= 2)[s.row_page[s.row]])
    c = Clusters.of(s.row_page[s.row[looked]], s.x[looked], s.row[looked], ANCHOR_CLUSTER, s.n_rows)
    a = np.flatnonzero(c.support >= np.maximum(3, (s.page_rows * ANCHOR_SHARE).astype(np.int64))[c.group])
    a = a[spaced(c.group[a], c.x[a])]
    n = count_of(c.group[a], s.n_pages)
    a = a[((n >= lim.least) & (n <= MAX_ANCHORS))[c.group[a]]]
    anchor_x, n = c.x[a], count_of(c.group[a], s.n_pages)
    start = starts_of(n)
    h = looked[s.headings()[looked]]
    i, j = cross(s.row_page[s.row[h]], start, n)
    near = np.abs(s.x[h[i]] - anchor_x[j]) < ANCHOR_CLUSTER
    pairs = np.unique(s.row[h[i[near]]] * (len(a) + 1) + j[near])
    score = count_of(pairs // (len(a) + 1), s.n_rows)
    rows = np.flatnonzero(n[s.row_page] > 0)
    rows = rows[np.lexsort((rows, -score[rows], s.row_page[rows]))]
    top = rows[changes(s.row_page[rows])]
    top = top[score[top] >= np.maximum(lim.least, (n[s.row_page[top]] * 2 / 3).astype(np.int64))]
    # the closest text of that row names an anchor
    k, span = s.spans_of(top)
    i, j = cross(s.row_page[top[k]], start, n)
    far = np.abs(s.x[span[i]] - anchor_x[j])
    near = np.flatnonzero(far < ANCHOR_CLUSTER)
    near = near[np.lexsort((i[near], far[near], j[near]))]
    near = near[changes(j[near])]
    table, name_at, x = k[i[near]], span[i[near]], anchor_x[j[near]]
    good = count_of(table, len(top)) >= lim.least
    keep = good[table]
    table, name_at, x, top = (np.cumsum(good) - 1)[table[keep]], name_at[keep], x[keep], top[good]
    on_page = np.full(s.n_pages, -1)
    on_page[s.row_page[top]] = np.arange(len(top))
    low, wrapped = s.lowest(s.row_page[top], top, count_of(table[s.one_word[name_at]], len(top)), lim)
    names = s.text.take(pa.array(name_at))
    if len(wrapped):
        names = ended(s, names, table, x, wrapped, on_page[s.row_page[wrapped]])
    end = np.full(s.n_pages, s.n_rows)
    end[s.row_page[top]] = top
    data = np.flatnonzero((np.arange(s.n_rows) > end[s.row_page]) & (s.y < low[s.row_page] - lim.y_tol))
    own = on_page[s.row_page[data]]
    return Rows(s, data, own, own, Columns.of(table, x, names, len(top)))


def ended(s: Sheets, names: pa.Array, table: np.ndarray, x: np.ndarray, rows: np.ndarray, tables: np.ndarray) -> pa.Array:
    """Names with the single words of the rows wrapped under them: each ends the nearest one without a space."""
    out, count = names.to_pylist(), count_of(table, int(table.max()) + 1)
    start = starts_of(count)
    for r, t in zip(rows, tables, strict=True):
        for span in range(s.row_start[r], s.row_start[r] + s.row_spans[r]):
            free = [(abs(s.x[span] - x[h]), h) for h in range(start[t], start[t] + count[t]) if " " not in out[h] and abs(s.x[span] - x[h]) < WRAP_REACH]
            if s.one_word[span] and free:
                out[min(free)[1]] += " " + s.text[int(span)].as_py()
    return pa.array(out, pa.string())


def found(s: Sheets, lim: Limits, ways: tuple[str, ...]) -> pa.Table:
    """Tables of pages by the ways named; if no filter follows, by anchors only where a page has none by gaps."""
    out, open_pages = [], np.ones(s.n_pages, bool)
    for way, name in enumerate(("gaps", "anchors")):
        if name not in ways:
            continue
        r, island = by_gaps(s, lim) if name == "gaps" else (by_anchors(s, lim, open_pages), None)
        to, first, kept = r.merged(lim.merge_gap, lim.max_row_gap)
        own = first[kept]
        table, page = r.table[own], s.row_page[r.rows[own]]
        new = changes(table)
        number = np.arange(len(own)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        if island is None:
            tables = np.zeros(len(own), np.int64)
        elif lim.chosen:
            nth = np.cumsum(new) - 1
            tables = nth - nth[changes(page)][np.cumsum(changes(page)) - 1] if len(own) else nth
        else:
            tables = island[table]
        if lim.chosen:
            open_pages[page] = False
        out.append(pa.table({"doc_id": s.doc_id.take(pa.array(s.page_doc[page])), "page": s.page_no.take(pa.array(page)), "way": pa.array(np.full(len(own), way), pa.int32()), "table_no": pa.array(tables, pa.int32()), "row_no": pa.array(number, pa.int32()), "y": pa.array(r.y[own]), "columns": r.columns.array().take(pa.array(table)), "cells": r.cells(to, first, kept)}))
    return pa.concat_tables(out)


FIELDS = ("span_seq", "x", "y", "end_x", "font_size", "text")
# what trim takes off: white space, the next-line character and separators
BLANK = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def replaced(text: pa.Array, where: np.ndarray, by: pa.Array) -> pa.Array:
    return pc.replace_with_mask(text, pa.array(where), by) if where.any() else text


def unpacked(b: pa.RecordBatch) -> pa.RecordBatch:
    """A row a span of rows with FIELDS in arrays: texts trimmed, without empty ones, and in lower case too."""
    counts = pc.fill_null(pc.list_value_length(b["text"]), 0).to_numpy()
    if any(not pc.fill_null(pc.list_value_length(b[f]), 0).equals(pa.array(counts, pa.int32())) for f in FIELDS):
        raise ValueError("the arrays of a row differ in length")
    row = pa.array(np.repeat(np.arange(b.num_rows), counts))
    col = {"doc_id": b["doc_id"].take(row), "page": b["page"].take(row)} | {f: b[f].flatten() for f in FIELDS}
    text = col["text"]
    plain = without_edges(text)
    text = replaced(text, ~plain, pc.utf8_trim(text.filter(pa.array(~plain)), BLANK))
    low, wide = pc.ascii_lower(text), ~pc.fill_null(pc.string_is_ascii(text), True).to_numpy(zero_copy_only=False)
    low = replaced(low, wide, pa.array([t.lower() for t in text.filter(pa.array(wide)).to_pylist()], pa.string()))
    out = pa.RecordBatch.from_pydict(col | {"text": text, "low": low})
    return out if plain.all() else out.filter(pc.not_equal(text, ""))


def whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 0) -> Iterator[pa.Table]:
    """Batches in order of keys as tables of whole documents or pages, of least rows or SPANS_AT_ONCE about."""
    least = least or SPANS_AT_ONCE
    held: list[pa.RecordBatch] = []
    n, enough = 0, least
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        t = pa.Table.from_batches(held)
        last = max(int(np.flatnonzero(changes(codes(t[k].combine_chunks())))[-1]) for k in keys)
        if last:
            yield t.slice(0, last)
            held, n, enough = t.slice(last).to_batches(), n - last, max(least, 2 * (n - last))
        else:
            enough = 2 * n
    if n:
        yield pa.Table.from_batches(held)
