"""Evaluation texts leaking into training text, found by Wu-Manber search over words.

The patterns are all five-word windows of the evaluation items (characters in Chinese).  Shift
tables over blocks of two words skip positions where no window can end, suffix buckets select
the windows to try, and direct comparison confirms them.  Documents whose confirmed windows
could make up half an item are then aligned exactly, word by word.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.runtime import cut

#: Words of a window, and words of a block of the shift tables.
WINDOW, BLOCK = 5, 2
#: Share of an item's words that makes a leak.
SHARE = 0.5
#: Most exchanged words in a stretch, as a share of it; a second one in a row ends the stretch.
EXCHANGED = 0.12
#: Most words inserted in a row (page numbers, marks of continuation) without ending a stretch.
INSERTED = 3
#: Characters of items that one set of tables holds; more items make more sets, each broadcast in a search of its own.
MAX_ITEM_CHARS = 16_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_JOIN = re.compile(r"(?<=\w)[.,'’\-­‐](?:\s*\n[>\s]*)?(?=\w)")
_WORD = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+")


def words(text: str) -> list[str]:
    """Words in order, without case, accents, punctuation, entities and layout marks; Chinese by character."""
    t = html.unescape(text) if "&" in text else text
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = unicodedata.normalize("NFKC", t).casefold()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).replace("ı", "i").replace("ł", "l")
    return _WORD.findall(_JOIN.sub("", t))


class Patterns:
    """Wu-Manber tables over the windows of all items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = {i: words(t or "") for i, t in items}
        self.items = {i: w for i, w in self.items.items() if w}
        self.shift: dict[tuple[str, str], int] = {}
        self.suffix: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        self.short = {i: w for i, w in self.items.items() if len(w) < WINDOW}
        for i, w in self.items.items():
            for at in range(len(w) - WINDOW + 1):
                for end in range(BLOCK, WINDOW + 1):
                    block = (w[at + end - 2], w[at + end - 1])
                    self.shift[block] = min(self.shift.get(block, WINDOW), WINDOW - end)
                self.suffix[(w[at + WINDOW - 2], w[at + WINDOW - 1])].append((i, at))

    def occurrences(self, doc: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Item → (position in the document, position in the item) of each window that occurs."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        shift, suffix, items = self.shift, self.suffix, self.items
        end, n, none = WINDOW, len(doc), WINDOW - BLOCK + 1
        while end <= n:
            block = (doc[end - 2], doc[end - 1])
            skip = shift.get(block, none)
            if skip:
                end += skip
                continue
            at = end - WINDOW
            window = doc[at:end]
            for i, k in suffix[block]:
                if items[i][k : k + WINDOW] == window:
                    hits[i].append((at, k))
            end += 1
        return hits

    def leaked(self, text: str) -> list[int]:
        """The items of which the text holds a stretch of at least SHARE of the words."""
        doc = words(text)
        found = []
        for i, hits in self.occurrences(doc).items():
            item = self.items[i]
            covered = {k + j for _, k in hits for j in range(WINDOW)}
            # every exchanged or inserted word can break at most WINDOW windows, so half of what is needed must be covered
            if 2 * len(covered) >= SHARE * len(item) and self._stretch(item, doc, hits) >= SHARE * len(item):
                found.append(i)
        for i, w in self.short.items():
            if any(doc[k : k + len(w)] == w for k in range(len(doc) - len(w) + 1)):
                found.append(i)
        return found

    @staticmethod
    def _stretch(item: list[str], doc: list[str], hits: list[tuple[int, int]]) -> int:
        """Length in words of the item's longest stretch that the document holds.

        Exact runs of common words are chained along the text: between two runs there may stand
        one exchanged word, or a few inserted or dropped ones; nothing else.
        """
        runs: dict[tuple[int, int], int] = {}
        for at, k in sorted(hits):  # windows on one diagonal that overlap make one run
            d = at - k
            last = runs.get(("d", d))
            if last is not None and at <= last[0] + last[2]:
                last[2] = max(last[2], at + WINDOW - last[0])
            else:
                runs[("d", d)] = last = [at, k, WINDOW]
                runs[(at, k)] = last
        todo = sorted((r for key, r in runs.items() if key[0] != "d"), key=lambda r: (r[0], r[1]))
        full = []
        for at, k, n in todo:  # grow over single exchanged words and the short runs behind them
            full.append(Patterns._grow(item, doc, at, k, n))
        full.sort(key=lambda r: (r[0], r[1]))
        best = 0
        chain: list[tuple[int, int, int, int, int]] = []  # doc end, item end, item start, exchanged, last insert
        for at, end, k, kend, swapped in full:
            cand = (end, kend, k, swapped)
            for e, ke, ks, sw in chain:
                gap_d, gap_i = at - e, k - ke
                if -WINDOW < gap_d and -WINDOW < gap_i and max(gap_d, gap_i) <= INSERTED and kend > ke and end > e and (gap_i <= 1 or gap_d <= 1) and ks < cand[2] and sw + swapped <= EXCHANGED * (kend - ks) + 1:
                    cand = (end, kend, ks, sw + swapped)
            chain.append(cand)
            if cand[3] <= EXCHANGED * (cand[1] - cand[2]) + 1:
                best = max(best, cand[1] - cand[2])
        return best

    @staticmethod
    def _grow(item: list[str], doc: list[str], at: int, k: int, n: int) -> tuple[int, int, int, int, int]:
        swapped = 0
        end, kend = at + n, k + n
        while kend < len(item) and end < len(doc):
            if item[kend] == doc[end]:
                end, kend = end + 1, kend + 1
            elif kend + 1 < len(item) and end + 1 < len(doc) and item[kend + 1] == doc[end + 1]:
                end, kend, swapped = end + 2, kend + 2, swapped + 1
            else:
                break
        while k > 0 and at > 0:
            if item[k - 1] == doc[at - 1]:
                at, k = at - 1, k - 1
            elif k > 1 and at > 1 and item[k - 2] == doc[at - 2]:
                at, k, swapped = at - 2, k - 2, swapped + 1
            else:
                break
        return at, end, k, kend, swapped


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_key, item_key), one row for each document and item whose text it holds wholly or by half.

    A stretch may have single exchanged words and short insertions; case, punctuation, spacing
    and layout marks do not matter.  Items shorter than a window must stand whole.  Null and
    empty texts hold nothing; copies of a document are found like any other.  The items are
    read to the driver set by set, at most MAX_ITEM_CHARS of them at once, and shipped with the
    search of that set; no row of the corpus is shuffled.  A set reads the corpus once.
    """
    rows = cut(items.where(F.col(text).isNotNull()).select(item_key, text).distinct())
    chars = rows.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    sets = max(1, math.ceil(2 * chars / MAX_ITEM_CHARS)) if chars > MAX_ITEM_CHARS else 1
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    corpus = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("d"), F.col(text).alias("t"))
    found = None
    for k in range(sets):
        part = rows.where(F.pmod(F.xxhash64(item_key), F.lit(sets)) == k).collect()
        if not part and sets > 1:
            continue
        one = corpus.mapInPandas(_search(docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part]), doc_key, item_key), f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}")
        found = one if found is None else found.unionByName(one)
    return found


def _search(shared, doc_key: str, item_key: str):  # noqa: ANN001, ANN202
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = Patterns(shared.value)
        for b in batches:
            got = [(d, i) for d, t in zip(b["d"], b["t"]) for i in patterns.leaked(t)]
            yield pd.DataFrame(got, columns=[doc_key, item_key])

    return search
