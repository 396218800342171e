"""Main body of web pages, by wrapper induction over pages of one host.

A page is a tree of lines.  Pages of one host are aligned by simple tree matching: nodes that
stay constant are its template, the rest are slots.  Lines that read the same on every compared
page of the host are its wrapper and decided by it.  How often a line's form is constant where it
can be compared is averaged over hosts, and that tells template from content where a host gives
little or no evidence.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tradeloom.runtime import cut, sql_text

#: Pages of a host that every page of it is aligned with, one per address.
REFERENCES = 4
#: Hosts that must have shown a form before its average counts; shares of constancy that make content or template.
LEAST_HOSTS, CONTENT_BELOW, TEMPLATE_FROM = 3, 0.4, 0.6

#: Reading aids that sites scatter over single pages, so that alignment sees them vary (lower case, numbers as 0).
WIDGETS = (
    r"chat now|live chat|leave (?:us )?a message|read more ?[»>→]*|more ?[»>→]+|like 0 +tweet|like 0|tweet|share|share (?:on social media|this page|via .*)|print(?: this)? page|print|download pdf|pdf|e-?mail this page|send to a friend|previous \| next|previous|next|back to top|top|scroll to top|add to (?:cart|wishlist|favou?rites)|rate this page|was this (?:page )?helpful\??|bookmark this page|follow us|subscribe",
    r"zurück \| weiter|weiterlesen ?[»>→]*|mehr ?[»>→]+|seite drucken|drucken|teilen|pdf herunterladen|nach oben|anterior \| siguiente|leer más ?[»>→]*|imprimir|compartir|descargar pdf|önceki \| sonraki|devamı ?[»>→]*|yazdır|paylaş|pdf indir|上一篇|下一篇|上一页 ?\| ?下一页|打印本页|打印|分享|分享到.*|在线客服|阅读更多 ?[»>→]*|查看更多 ?[»>→]*|返回顶部|下载pdf",
)
_MAIL = r"^\s*(?:(?:e-?mail|mail|邮箱|电子邮箱)\s*[:：]?\s*)?[\w.+-]+@[\w.-]+\.\w+\s*$"
_PHONE = r"(?i)^\s*(?:☎|(?:phone|tel|telefon|teléfono|telefono|mobile|t|电话)\b)?[.:：]?\s*(?:tel[.:]?\s*)?[+(]?\d[\d\s()+/.-]{6,}(?:\s*ext\.?\s*\d+)?\s*$"
#: Separators of link bars; a line is cut at the first kind that it has.
_BARS = (r"\s{2,}", r"\s*·\s*", r"\s*»\s*", r"\s*>\s*", r"\s+/\s+", r"\s*\|\s*")
_CUT = r"(?:…|\.\.\.|\[(?:more|mehr|más|devamı|更多)\])\s*$"


def aligned_nodes(page: list[int], ref: list[int]) -> list[int]:
    """For each line of ``page``, the line of ``ref`` that simple tree matching aligns it with, or -1.

    Lines are the ordered children of the two roots, so the largest matching that keeps their
    order is their longest common subsequence; a line that moved past it is not constant.
    """
    where: dict[int, list[int]] = {}
    for j in range(len(ref) - 1, -1, -1):
        where.setdefault(ref[j], []).append(j)
    tails: list[int] = []
    heads: list[int] = []
    nodes: list[tuple[int, int, int]] = []  # (line, reference line, previous node)
    for i, s in enumerate(page):
        for j in where.get(s, ()):
            k = bisect_left(tails, j)
            nodes.append((i, j, heads[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                heads.append(len(nodes) - 1)
            else:
                tails[k] = j
                heads[k] = len(nodes) - 1
    got = [-1] * len(page)
    at = heads[-1] if heads else -1
    while at >= 0:
        i, j, at = nodes[at]
        got[i] = j
    return got


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _align(sigs: pd.Series, exact: pd.Series, url: pd.Series, refs: pd.Series) -> pd.Series:
    """Per line: the reference pages it could be compared with, those where it is constant, and those where it reads the same to the letter."""
    out = []
    for own, letters, u, others in zip(sigs, exact, url, refs):
        own = list(own)
        tried, same, equal = 0, [0] * len(own), [0] * len(own)
        for r in others if others is not None else ():
            ref = list(r["sigs"])
            if r["url"] != u and ref != own:
                tried += 1
                for i, j in enumerate(aligned_nodes(own, ref)):
                    if j >= 0:
                        same[i] += 1
                        equal[i] += letters[i] == r["exact"][j]
        out.append([[tried] * len(own), same, equal])
    return pd.Series(out)


def _signatures(line: str) -> dict[str, str]:
    """Forms of a line: with numbers masked; also with capitalised words masked; its first two words, with marks for what follows and how it ends."""
    ids = f"regexp_replace({line}, {sql_text(r'\b[A-Z]{1,4}[-/]?\d{2,}\b')}, 'ID')"
    flat = f"trim(regexp_replace(regexp_replace({ids}, {sql_text(r'\d+(?:[.,]\d+)*')}, '0'), {sql_text(r'(?U)\s+')}, ' '))"
    names = f"regexp_replace(regexp_replace({flat}, {sql_text(r'\p{Lu}[\p{L}.''&-]*'.replace(chr(39) * 2, chr(39)))}, '*'), {sql_text(r'\*(?: \*)+')}, '*')"
    first = f"regexp_extract(lower({flat}), {sql_text(r'^(\P{L}*(?:[一-鿿]{1,4}|[^\s一-鿿]+ ?[^\s一-鿿]*))')}, 1)"
    return {"s0": f"xxhash64(trim(regexp_replace({line}, {sql_text(r'(?U)\s+')}, ' ')))", "s1": f"lower({flat})", "s2": f"lower({names})", "s3": f"concat({first}, CASE WHEN length({flat}) > length({first}) THEN '+' ELSE '' END, CASE WHEN {line} RLIKE {sql_text(_CUT)} THEN '~' WHEN {line} RLIKE {sql_text(r'[.!?。！？]\s*$')} THEN '.' ELSE '' END)"}


def _average(nodes: DataFrame, form: str) -> DataFrame:
    """(form, rate, hosts): constancy of a form, averaged over the hosts that can tell."""
    per_host = nodes.where("tried > 0").groupBy(form, "host").agg((F.sum("same") / F.sum("tried")).alias("r"))
    return per_host.groupBy(form).agg(F.avg("r").alias(f"{form}_rate"), F.count(F.lit(1)).alias(f"{form}_hosts"))


def _decided(form: str) -> Column:
    rate, hosts = F.col(f"{form}_rate"), F.col(f"{form}_hosts")
    return F.when((hosts >= LEAST_HOSTS) & (rate < CONTENT_BELOW), F.lit(False)).when((hosts >= LEAST_HOSTS) & (rate >= TEMPLATE_FROM), F.lit(True))


def body_lines(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "text") -> DataFrame:
    """(key, line_no, line): the lines of each page's main body.

    Lines are what ``\\n`` separates, counted from 1 with the empty ones; empty lines are no
    body.  A page is aligned with up to REFERENCES other addresses of its host, never with
    copies of itself; pages of a host seen once are judged by forms known from other hosts,
    and forms nobody knows by whether they read like sentences.  Address, phone and mail lines
    are body where they lead up to a mail line.  Null texts have no lines; null addresses make
    a host of their own.  Page keys are unique.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z]+:)?/*([^/?#]+)", 1), F.lit(""))
    forms = _signatures("l.line")
    lines = F.expr(f"transform(filter(transform(split(`{text}`, '\\n'), (x, i) -> named_struct('n', i + 1, 'line', x)), l -> trim(regexp_replace(l.line, '[\\\\s\\\\u00a0\\\\u3000]+', ' ')) <> ''), l -> named_struct('n', l.n, 'line', l.line, 's0', {forms['s0']}, 's1', {forms['s1']}, 's2', {forms['s2']}, 's3', {forms['s3']}))")
    base = pages.where(F.col(text).isNotNull()).select(F.col(key).alias("page"), host.alias("host"), F.xxhash64(F.coalesce(F.col(url), F.lit(""))).alias("url"), lines.alias("lines"))
    base = base.withColumn("sigs", F.transform("lines", lambda x: F.xxhash64(x["s1"]))).withColumn("exact", F.col("lines.s0"))

    # One page per address, the REFERENCES smallest hashes of each host; the limit applies before the shuffle.
    near = Window.partitionBy("host").orderBy(F.xxhash64("url"), "url")
    one = base.groupBy("host", "url").agg(F.min_by(F.struct("sigs", "exact"), "page").alias("x")).select("host", "url", "x.*")
    refs = one.withColumn("k", F.row_number().over(near)).where(F.col("k") <= REFERENCES + 1).groupBy("host").agg(F.collect_list(F.struct("url", "sigs", "exact")).alias("refs"))
    aligned = base.join(refs, "host").withColumn("m", _align("sigs", "exact", "url", "refs"))
    rows = cut(aligned.select("page", "host", F.explode(F.arrays_zip("lines", F.col("m")[0].alias("tried"), F.col("m")[1].alias("same"), F.col("m")[2].alias("equal"))).alias("x")).select("page", "host", "x.lines.*", "x.tried", "x.same", "x.equal"))

    # Nodes: the distinct lines of a host; forms are averaged over hosts and joined to the nodes only.
    nodes = rows.groupBy("host", "s0", "s1", "s2", "s3").agg(F.sum("tried").alias("tried"), F.sum("same").alias("same"), F.sum("equal").alias("equal"), F.max("tried").alias("refs"), F.min("line").alias("line"))
    known = {form: _average(nodes, form) for form in ("s1", "s2", "s3")}
    # A bar of links is furniture if each of its parts is: parts are looked up as lines of their own.
    cuts = " ".join(f"WHEN trim(line) RLIKE {sql_text(rf'\S(?:{c})\S')} THEN split(trim(line), {sql_text(c)})" for c in _BARS)
    masked = "lower(trim(regexp_replace(regexp_replace(p, '\\\\d+', '0'), '\\\\s+', ' ')))"
    parts = nodes.withColumn("part", F.explode(F.expr(f"filter(transform(CASE {cuts} END, p -> {masked}), p -> p <> '')")))
    names = known["s1"].where(_decided("s1")).select(F.col("s1").alias("part"), F.lit(1).alias("known"))
    bars = parts.join(names, "part", "left").groupBy("host", "s0").agg(((F.count(F.when(F.col("known").isNotNull() | (F.length("part") <= 3), 1)) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 1)).alias("bar"))
    for form, rates in known.items():
        nodes = nodes.join(rates, form, "left")
    nodes = nodes.join(bars, ["host", "s0"], "left")
    line = F.col("line")
    own = F.when(F.col("tried") > 0, F.col("same") >= 0.5 * F.col("tried"))
    # The host's wrapper comes first: what reads the same to the letter on every page that it is compared with.
    # Where there is but one, lines that other hosts have as well may coincide.
    wrapper = (F.col("tried") > 0) & (F.col("equal") >= F.col("tried")) & ((F.col("refs") >= 2) | (F.coalesce(F.col("s1_hosts"), F.lit(0)) <= 1))
    label = F.regexp_replace(F.regexp_replace(F.col("host"), r"^www\.", ""), r"[^a-z]", "")
    bare = F.regexp_replace(F.lower(line), r"[^a-z]", "")
    brand = (F.length(bare) >= 5) & label.startswith(bare)
    reads = line.rlike(r"[.!?。！？]\s*$") & ((F.size(F.split(F.trim(line), r"\s+")) >= 5) | line.rlike(r"[一-鿿]{6}"))
    contact = line.rlike(r"\d") & ~reads & (F.size(F.split(F.trim(line), r"[,;/|\n]|\s[-–]\s|\s")) >= 3) & (F.coalesce(F.col("s1_hosts"), F.lit(0)) <= 2)
    guess = F.when(line.rlike(_CUT), True).when(reads, False).otherwise(line.rlike(_PHONE) | contact)
    named = F.when(F.regexp_replace("s2", r"[^\p{L}]", "") != "", _decided("s2"))  # nothing but names and numbers is no form
    widget = F.col("s1").rlike("^(?:" + "|".join(WIDGETS) + ")$")
    furniture = F.when(line.rlike(_MAIL), F.coalesce(own & (F.col("tried") >= 3), F.lit(False))).when(wrapper | widget | brand | F.coalesce(F.col("bar"), F.lit(False)), True).otherwise(F.coalesce(_decided("s1"), F.when(reads | line.rlike(_CUT), F.coalesce(_decided("s3"), named)), own, named, _decided("s3"), guess))
    judged = nodes.select("host", "s0", furniture.alias("furniture"), contact.alias("own_line"), (widget | F.coalesce(F.col("bar"), F.lit(False)) | (F.coalesce(F.col("s1_hosts"), F.lit(0)) >= LEAST_HOSTS)).alias("common"))

    # Up to a mail line of the body, the phone before it and the address before that are body as well.
    # Furniture that many hosts have may stand between them.
    between = F.col("furniture") & F.col("common") & ~F.col("phone")
    order = Window.partitionBy("page").orderBy("n")
    seen = rows.join(judged, ["host", "s0"]).withColumn("mail", line.rlike(_MAIL) & ~F.col("furniture")).withColumn("phone", line.rlike(_PHONE)).where(~between)
    seen = seen.withColumns({"next_mail": F.coalesce(F.lead("mail", 1).over(order), F.lit(False)), "next_phone": F.coalesce(F.lead("phone", 1).over(order), F.lit(False)), "then_mail": F.coalesce(F.lead("mail", 2).over(order), F.lit(False))})
    leads = F.col("next_mail") | (F.col("next_phone") & F.col("then_mail"))
    body = ~F.col("furniture") | (F.col("phone") & F.col("next_mail")) | (leads & F.col("own_line") & ~F.col("phone") & ~line.rlike(_CUT))
    return seen.where(body).select(F.col("page").alias(key), F.col("n").cast("int").alias("line_no"), "line")
