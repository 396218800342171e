"""Template residue, filler, error pages and script notices in documents.

Documents are cut into lines and sentences; distinct masked segments are the nodes of a graph.
Segments that partitioned SimHash tables bring together are linked if Hamming distance and text
similarity verify them.  Anything in template marks is a slot; a slot's wording is linked with
the frames of words that it stands in.  A small seed of trusted labels is propagated through the
connected components: from a few unmistakable slots over the frames to every other wording of a
slot, and from known messages and filler to their near-duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.operators.components import connected_components
from tradeloom.runtime import cut, small_side, sql_text

#: Words of a shingle of long segments, letters of a group of short ones, words from which a segment is long, and least Jaccard similarity of a link.
SHINGLE, GROUP, LONG, SIMILARITY = 5, 3, 40, 0.8
#: Most differing bits of two fingerprints; a pair of SIMILARITY differs in about 10 of 64 and shares a table's cell with probability RECALL over all tables.
HAMMING, RECALL = 18, 0.98

#: Marks in which templates put what is to be filled in, and what programs print for nothing (lower-case text, numbers as 0).
SLOT = "|".join((
    r"\{\{[^{}\n]{0,60}\}\}", r"\{%[^{}\n]{1,60}%\}", r"<%[^<>\n]{1,60}%>", r"[$#]\{[^{}\n]{1,60}\}", r"\[\[[^\[\]\n]{1,60}\]\]", r"<<[^<>\n]{1,60}>>",
    r"%%?[a-z]{2,}(?:_[a-z]+)*%%?", r"__[a-z]+(?:_[a-z]+)*__", r"@@[a-z_ ]{2,40}@@", r"##?[a-z]+(?:_[a-z]+)*##?(?!\w)", r"\*\|[a-z_:]{2,40}\|\*",
    r"\{[^{}\n]{1,60}\}", r"\[[^\[\]\n]{2,60}\]", r"【[^【】\n]{2,40}】", r"«[^«»\n]{2,40}»", r"<[^<>=/\n]+ [^<>=/\n]+>", r"\bx{2,}[.,/-]x{2,}\b", r"\b(?:undefined|null|nan|none)\b",
))
#: Trusted slots: marks that nothing but a template engine uses, and numbered places.
TRUSTED_SLOTS = r"\{\{[^{}]*\}\}|\{%[^{}]+%\}|<%[^<>]+%>|\$\{[^{}]+\}|\{0\}"
#: A slot's wording is a node of its own if it has letters and is no plain word.
_WORDED = r"^(?=.*\p{L}\P{L}*\p{L})(?!(?:undefined|null|nan|none)$)"

#: Trusted messages: how segments begin or read that stand where content should (lower-case text, numbers as 0).
TRUSTED_MESSAGES = (
    # what programs print for nothing, where a name should stand
    r"(?::|^dear|^hello) (?:undefined|null|nan)[,.;]",
    # scripts required
    r"(?:enable|activate|turn on|allow) (?:java ?script|scripts)\b.{0,12}(?:\bto\b|\bin your\b|\band\b|$|\.)",
    r"java ?script (?:is|must be) (?:disabled|turned off|required)",
    r"(?:site|page|shop|app) (?:requires|needs) (?:java ?script|scripts)\b",
    r"\bbrowser (?:is out of date|blocks scripts)\b",
    r"aktivieren sie (?:bitte )?java ?script",
    r"(?:active|habilite) java ?script",
    r"java ?script['’]?i etkinleştirin",
    r"(?:启用|开启)[^。]{0,6}(?:java ?script|脚本)",
    # error pages
    r"^\W*(?:error )?0\W{1,3}(?:page )?(?:not found|forbidden|internal server error|bad gateway|service unavailable)",
    r"page you were looking for",
    r"^(?:the )?(?:service|server|site|website) (?:is )?temporarily unavailable",
    r"\berror establishing a database connection",
    r"this (?:site|page) can['’]?t be reached",
    r"^traceback \(most recent call last\)",
    r"^[a-z.]+exception at \b|^fatal error: uncaught|^warning: [a-z_]+\(\)",
    r"\b(?:product|page|item) [^.]{0,20}you requested is gone",
    r"^too many requests from your",
    r"^seite nicht gefunden|gewünschte (?:adresse|seite) existiert nicht",
    r"^página no encontrada",
    r"aradığınız sayfa bulunamadı|aradiğiniz sayfa bulunamadi",
    r"页面不存在",
    # blocking, log-in and parking
    r"^access denied|^your request was blocked",
    r"verify that you are not a robot",
    r"^(?:your )?session (?:has )?expired",
    r"^account suspended",
    r"\bdomain is for sale",
    # filler
    r"^heading goes here|\byour text goes here",
    r"^this is a sample (?:paragraph|page)|^just another sample page",
    r"^delete this and start writing",
    r"\basdf asdf\b|^(?:tbd\W*){2,}$|^(?:product description\W*){2,}",
    r"hier steht ein blindtext",
    r"texto de ejemplo",
    r"buraya metin gelecek",
    r"此处为示例文字",
)

#: Words of the usual Latin filler.
FILLER = "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"


def _segments(text: str) -> str:
    t = f"replace(replace(replace(replace(replace({text}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' ', ' ')"
    return f"split(lower({t}), {sql_text(r'[\r\n]+|(?<=[.!?])\s+|(?<=[。！？])')})"


def _key(segment: str) -> str:
    """A segment with white space collapsed, list marks dropped and numbers masked."""
    return f"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({segment}, {sql_text(r'^[\s>*•·|-]+')}, ''), {sql_text(r'(?U)\s+')}, ' ')), {sql_text(r'\b[a-z]{2}-\d{4}\b')}, 'id'), {sql_text(r'\d+([.,:]\d+)*')}, '0')"


def segment_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seg): the masked lines and sentences of every document; nulls and empty texts have none."""
    return docs.where(F.col(text).isNotNull()).select(F.col(key), F.explode(F.expr(f"filter(array_distinct(transform({_segments(f'`{text}`')}, s -> {_key('s')})), s -> length(s) > 2)")).alias("seg"))


def trusted(seg: str = "seg") -> Column:
    """True for segments that are residue by themselves: known messages and Latin filler."""
    filler = "|".join(sorted(set(FILLER.split())))
    latin = F.size(F.expr(f"regexp_extract_all({seg}, {sql_text(rf'\b({filler})\b')}, 1)"))
    words = F.size(F.expr(f"regexp_extract_all({seg}, {sql_text(r'(?U)(\w+)')}, 1)"))
    rules = "|".join(f"(?:{p})" for p in TRUSTED_MESSAGES)
    return F.col(seg).rlike(f"(?U){rules}") | ((words >= 4) & (latin >= 0.6 * words))


def slots(segs: DataFrame) -> DataFrame:
    """(seg, slot, frame) of every slot: what stands in the marks, and each frame of words around it.

    A frame is the two words on either side (at least three in all), or three words on one side.
    """
    marked = f"regexp_replace(seg, {sql_text('(?U)' + SLOT)}, ' ¤ ')"
    words = f"regexp_extract_all({marked}, {sql_text(r'(?U)¤|[一-鿿]|[^\W一-鿿]+|[–—]')}, 0)"
    rows = segs.select("seg", F.expr(f"regexp_extract_all(seg, {sql_text('(?U)' + SLOT)}, 0)").alias("slot"), F.expr(words).alias("w")).where("size(slot) > 0")
    rows = rows.withColumn("at", F.expr("filter(sequence(1, size(w)), i -> w[i - 1] = '¤')"))
    rows = rows.select("seg", "w", F.explode(F.arrays_zip("slot", "at")).alias("x")).select("seg", "w", "x.slot", "x.at").where("at IS NOT NULL AND slot IS NOT NULL")
    part = lambda a, b: f"array_join(slice(w, greatest(at - {a}, 1), least(size(w), at + {b}) - greatest(at - {a}, 1) + 1), ' ')"
    frames = f"array(CASE WHEN least(at - 1, 2) + least(size(w) - at, 2) >= 3 THEN {part(2, 2)} END, CASE WHEN at > 3 THEN {part(3, 0)} END, CASE WHEN size(w) - at >= 3 THEN {part(0, 3)} END)"
    return rows.select("seg", "slot", F.explode(F.expr(f"filter(array_append({frames}, ''), f -> f IS NOT NULL)")).alias("frame"))


def slot_residue(marks: DataFrame, seeds: str = TRUSTED_SLOTS) -> DataFrame:
    """(seg): segments with a trusted slot, or with a slot or frame in one connected component with one.

    ``marks`` is what ``slots`` gives.  Edges join a slot's wording with each of its frames, so
    labels spread from trusted slots to the frames that they stand in, to the other wordings in
    these frames, and to their frames.  What programs print for nothing is an ordinary word
    elsewhere, so it takes its label from a frame and hands none on.
    """
    marks = cut(marks.withColumns({"s": F.xxhash64(F.lit("slot"), "slot"), "f": F.when(F.col("frame") != "", F.xxhash64(F.lit("frame"), "frame"))}))
    worded = marks.where(F.col("slot").rlike(_WORDED) | F.col("slot").rlike(f"^(?:{seeds})$"))
    part = connected_components(worded.where("f IS NOT NULL").select(F.col("s").alias("a"), F.col("f").alias("b")))
    first = worded.where(F.col("slot").rlike(f"^(?:{seeds})$")).select("s").distinct()
    good = part.join(first, F.col("node") == F.col("s"), "left_semi").select("component").distinct()
    nodes = part.join(good, "component", "left_semi").select("node").union(first).distinct()
    named = worded.join(nodes, F.col("s") == F.col("node"), "left_semi").select("seg")
    framed = marks.join(nodes, F.col("f") == F.col("node"), "left_semi").select("seg")
    return named.union(framed).distinct()


def _features(seg: str) -> str:
    """Distinct hashes of a segment's letter groups, or of its shingles if it is long."""
    units = f"regexp_extract_all({seg}, {sql_text(r'(?U)([一-鿿]|[^\W一-鿿]+|[^\s\w])')}, 1)"
    words = f"transform(array({units}), u -> CASE WHEN size(u) < {LONG} THEN NULL ELSE array_distinct(transform(sequence(1, size(u) - {SHINGLE - 1}), i -> xxhash64(array_join(slice(u, i, {SHINGLE}), ' ')))) END)[0]"
    letters = f"array_distinct(transform(sequence(1, greatest(length({seg}) - {GROUP - 1}, 1)), i -> xxhash64(substring({seg}, i, {GROUP}))))"
    return f"coalesce({words}, {letters})"


def simhash(features: pd.Series) -> np.ndarray:
    """64-bit SimHash of each array of hashes: each bit is the majority of the features' bits."""
    out = np.zeros(len(features), dtype=np.int64)
    for at in range(0, len(features), 256):
        some = features.iloc[at : at + 256]
        n = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        flat = np.concatenate([np.asarray(f, dtype=np.int64) for f in some]).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(np.unpackbits(flat, axis=1).astype(np.int32), np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        out[at : at + 256] = np.packbits(2 * ones > n[:, None], axis=1).view(np.int64).ravel()
    return out


def fingerprints(segs: DataFrame) -> DataFrame:
    """(seg, sim): the SimHash of distinct segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"seg": b["seg"], "sim": simhash(b["x"])})

    return segs.select("seg", F.expr(_features("seg")).alias("x")).mapInPandas(run, "seg string, sim bigint")


def simhash_tables(bits: int) -> np.ndarray:
    """Which fingerprint bits make the cells of each table: as many tables as find a pair of SIMILARITY with probability RECALL."""
    cosine = 2 * SIMILARITY / (1 + SIMILARITY)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(64)[:bits] for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - agree)))])


def _cells(df: DataFrame, bits: int, prefix: str = "") -> DataFrame:
    """One row for each table, with the table's cell of the row's fingerprint."""
    places = simhash_tables(bits)
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf("array<bigint>")
    def cells(sim: pd.Series) -> pd.Series:
        all_bits = np.unpackbits(sim.to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        tab = np.arange(len(places), dtype=np.int64) << 32
        return pd.Series(list((all_bits[:, places.ravel()].reshape(len(sim), *places.shape) @ weights) | tab))

    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns], F.explode(cells("sim")).alias("cell"))


def widen(nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """(seg): ``labelled`` and every node in a connected component with one of them.

    ``nodes`` and ``labelled`` are (seg, sim).  Two nodes are linked if they share a cell of a
    SimHash table, differ in at most HAMMING bits and their texts reach SIMILARITY.  Each round
    joins only the latest additions, so the work follows the residue, not the corpus; the last
    round adds nothing.
    """
    bits = int(np.clip(math.ceil(math.log2(max(nodes.count(), 2))) - 1, 8, 30))
    sims = nodes.select("sim").distinct()  # tables hold fingerprints, not texts
    known = front = cut(labelled)
    while front.limit(1).count():
        probes = cut(_cells(front, bits, "a_"))
        near = _cells(sims, bits).join(small_side(probes), "cell").where(F.bit_count(F.col("sim").bitwiseXOR(F.col("a_sim"))) <= HAMMING)
        near = small_side(cut(near.select("sim", "a_seg").distinct()))
        pairs = nodes.join(near, "sim").where("seg <> a_seg").withColumns({"x": F.expr(_features("seg")), "y": F.expr(_features("a_seg"))})
        alike = pairs.where(F.size(F.array_intersect("x", "y")) >= SIMILARITY * F.size(F.array_union("x", "y")))
        front = cut(alike.select("seg", "sim").distinct().join(known.select("seg"), "seg", "left_anti"))
        known = known.unionByName(front)
    return known.select("seg")


def residue_segments(segs: DataFrame) -> DataFrame:
    """(seg): the distinct segments that are residue, from ``segs`` (seg), by propagation from the trusted seed."""
    nodes = segs.select("seg").distinct()
    marks = cut(slots(nodes))
    plain = cut(fingerprints(nodes.join(marks.select("seg").distinct(), "seg", "left_anti")))
    return widen(plain, plain.where(trusted("seg"))).union(slot_residue(marks)).union(marks.where(trusted("seg")).select("seg")).distinct()


def residue_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key): documents that are, or contain, template residue, filler, error pages or script notices.

    Whole texts are read and cut once.  Copies are found like their originals; null and empty
    texts hold no residue; an empty table gives no rows.  Text that only mentions such things has
    none of the trusted forms, is no near-duplicate of one, and its marks stand in other frames.
    """
    segs = cut(segment_keys(docs, key, text))
    labels = cut(residue_segments(segs))
    return segs.join(small_side(labels), "seg", "left_semi").select(key).distinct()


def clean_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the residue documents, with all columns."""
    return docs.join(residue_documents(docs, key, text), key, "left_anti")
