import random

from pyspark.sql import functions as F

from tradeloom.llm import residue


def _alike(rng, n):
    """Pairs of segments whose feature sets reach the least similarity, most of them barely."""
    out = []
    while len(out) < n:
        a = "".join(rng.choice("abcdefgh ") for _ in range(60))
        i = rng.randrange(5, 50)
        b = a[:i] + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 4))) + a[i + 1 :]
        x, y = ({t[k : k + residue.GROUP] for k in range(len(t) - residue.GROUP + 1)} for t in (a, b))
        if len(x & y) >= residue.SIMILARITY * len(x | y):
            out.append((a, b))
    return out


def test_tables_find_pairs_of_least_similarity(spark):
    pairs = _alike(random.Random(4), 300)
    a, b = (residue.fingerprints(spark.createDataFrame([(p[k],) for p in pairs], "seg string")) for k in (0, 1))
    sims = [dict(map(tuple, side.collect())) for side in (a, b)]
    apart = [bin((sims[0][x] ^ sims[1][y]) & (2**64 - 1)).count("1") for x, y in pairs]
    assert sum(d <= residue.HAMMING for d in apart) >= 0.99 * len(pairs)
    got = {r.seg for r in residue.widen(b, a).collect()}
    assert sum(y in got for _, y in pairs) >= 0.95 * len(pairs)


def test_long_segments_are_compared_by_shingles(spark):
    words = [f"w{k}x" for k in range(60)]
    rows = [" ".join(words), " ".join([*words[:30], "other", *words[31:]]), " ".join(reversed(words))]
    nodes = residue.fingerprints(spark.createDataFrame([(r,) for r in rows], "seg string"))
    assert {r.seg for r in residue.widen(nodes, nodes.where(F.col("seg") == rows[0])).collect()} == set(rows[:2])


def test_labels_spread_from_a_withheld_seed(spark):
    """Of nine wordings of a slot one is trusted; the frames that they share give the rest away."""
    marks = ["{{name}}", "[your company]", "<firmenname einfügen>", "##port##", "__moq__", "@@material@@", "[ürün adı]", "xx.xx usd", "【请填写公司名称】"]
    frames = ["delivery from {} takes 0 days.", "welcome to {}, your partner.", "price per piece: {}, minimum 0."]
    rng = random.Random(3)
    bad = {frames[0].format(m) for m in marks} | {rng.choice(frames[1:]).format(m) for m in marks} | {"{} – king pin, cast iron".format(m) for m in marks[1:3]} | {"delivery from undefined takes 0 days."}
    good = {"the key [a] opens the lock.", "see table [0] of the drawing.", "undefined edges are broken to 0 mm.", "the order key is {series}{bore}.", "the part fits <b>all</b> frames."}
    df = spark.createDataFrame([(t,) for t in sorted(bad | good)], "seg string")
    seed = df.where(F.col("seg").rlike(residue.TRUSTED_SLOTS)).count()
    got = {r.seg for r in residue.slot_residue(residue.slots(df)).collect()}
    assert got == bad and seed == 2
    assert residue.slot_residue(residue.slots(df.limit(0))).count() == 0
