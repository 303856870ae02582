"""Personal data: fixed patterns, and spans that boosted trees choose among many candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import map_slices
from tabloom.session import durable

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base spans.  Quantifiers are possessive and starts are fenced where a retry inside a run
# could never succeed, so that each text is read in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            # a run before an @ cannot serve the next one, as the class leaves out @
            done = at + 1
            at = text.find("@", at + 1)


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: matches run leftmost and do not overlap within a kind; failing ones are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _card_ok(m.group())]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- candidates

# Generators of high recall: their spans may overlap each other and the base spans.  An address starts at its
# separator, since these are rare where words are not.
_AT = re.compile(r"(?:@| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{2,24}+)+")
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_NUMBERS = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}+(?:[.][0-9]{1,3}+){3,5}"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|\()?[0-9]{1,4}\)?(?:[ ./()-]{1,3}[0-9]{2,5}){2,5}(?![0-9])"),
}
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}")
#: Words near a span that speak for its kind, and words that speak for a plain number.
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|server|host|address|login|gateway)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|payment|iban|account|cvv)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|fax|mobile|cell|contact|whatsapp)\b", re.I),
}
_PLAIN = re.compile(r"\b(?:version|v|isbn|issn|order|invoice|id|no|nr|page|chapter|section|total|sum|price|eur|usd|doi|build)\b", re.I)
#: Characters of context on either side.
AROUND = 40

FEATURES = ("email", "ip", "card", "phone", "length", "digits", "digit_share", "groups", "longest_group", "separators", "kinds_of_separator",
            "letters", "luhn", "octets", "plus", "at_sign", "brackets", "same_digit_share", "context", "plain", "upper_share",
            "word_before", "word_after", "newline_near", "digits_near", "cue", "colons")


def _cue(kind: str, before: str) -> int:
    """1 where the last telling word before a span speaks for its kind, -1 where it speaks for a plain number, 0 without one."""
    speaks = max((m.end() for m in _CONTEXT[kind].finditer(before)), default=0)
    plain = max((m.end() for m in _PLAIN.finditer(before)), default=0)
    return (speaks > plain) - (plain > speaks)


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    before, after = text[max(0, start - AROUND): start], text[end: end + AROUND]
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    seps = re.findall(r"[^0-9A-Za-z]+", span)
    near = before + " " + after
    return [
        *(float(kind == k) for k in KINDS), float(len(span)), float(len(digits)), len(digits) / len(span), float(len(groups)),
        float(max(map(len, groups), default=0)), float(len(seps)), float(len(set(seps))), float(sum(c.isalpha() for c in span)),
        float(len(digits) > 0 and luhn(digits)), float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(span.startswith("+")), float("@" in span), float("(" in span or "[" in span),
        max((digits.count(d) for d in set(digits)), default=0) / max(1, len(digits)),
        float(bool(_CONTEXT[kind].search(near))), float(bool(_PLAIN.search(near))),
        sum(c.isupper() for c in near) / max(1, len(near)), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float("\n" in near), float(sum(c.isdigit() for c in near)), float(_cue(kind, before)), float(span.count(":")),
    ]


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _AT.finditer(text):
        local = _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())
        if local:
            yield "email", local.start(), m.end()
    for kind, pattern in _NUMBERS.items():
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()
    if text.count(":") >= 3:
        for m in _COLONS.finditer(text):
            yield "ip", m.start(), m.end()


#: A plain word speaks for the number that follows within so many characters.
CLOSE = 12
_TIME = re.compile(r"[0-9]{1,2}(?::[0-9]{1,2})+")
_BARE_AT = re.compile(r" at [A-Za-z0-9.-]+$")


def known_plain(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a candidate is known to be no personal data: it fails a check of its kind or a plain word stands before it.

    A candidate that is not known to be plain is not known to be personal data either.
    """
    span = text[start:end]
    digits = _digits(span)
    if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
        return True
    if kind == "phone" and not 7 <= len(digits) <= 15:
        return True
    if kind == "ip" and ":" in span and (_TIME.fullmatch(span) or (span.count(":") != 7 and "::" not in span)):
        return True
    if kind == "ip" and ":" not in span and (span.count(".") != 3 or not _ip_ok(span)):
        return True
    before = text[max(0, start - AROUND): start]
    if kind == "email":
        around = before + " " + text[end: end + AROUND]
        if any(c.isdigit() for c in re.split(r"[^A-Za-z0-9]+", span.rstrip(")]"))[-1]):
            return True
        # `look at site.org` names a place where no word around speaks of an address
        return bool(_BARE_AT.search(span)) and not _CONTEXT[kind].search(around)
    close = re.split(r"[.;!?\n]", before[-CLOSE:])[-1] if _PLAIN.search(before) else ""
    return bool(_PLAIN.search(close)) and _cue(kind, before) < 0


def disguised(kind: str, span: str, turn: int) -> str:
    """The same personal data in a form that the fixed patterns leave out; `turn` picks among the forms."""
    d = _digits(span)
    if kind == "email":
        local, _, domain = span.rpartition("@")
        return (f"{local} at {domain.replace('.', ' dot ')}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} (at) {domain}",
                f"{local} at {domain}")[turn % 4]
    if kind == "ip":
        a, b, c, e = map(int, span.split("."))
        return (f"2001:db8::{a:x}:{b:x}:{c:x}{e:02x}", f"fe80::{a:x}{b:02x}:{c:x}:{e:x}",
                f"2a02:{a:x}:{b:x}:{c:x}:{e:x}:{a:x}{c:02x}:{b:x}{e:02x}:{e:x}{a:02x}")[turn % 3]
    if kind == "card":
        amex = next(d[:14] + x for x in "0123456789" if luhn(d[:14] + x))
        return (".".join(re.findall("[0-9]{1,4}", d)), f"{amex[:4]} {amex[4:10]} {amex[10:]}", f"{amex[:4]}-{amex[4:10]}-{amex[10:]}")[turn % 3]
    n = d[-10:] if len(d) > 10 else d
    return (f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"0{n[:2]} {n[2:5]} {n[5:]}", f"{n[:3]} {n[3:6]} {n[6:]}")[turn % 5]


def example(kind: str, text: str, start: int, end: int) -> list[float]:
    """Features of a base span in disguise, in its own place."""
    before, span = text[max(0, start - AROUND): start], disguised(kind, text[start:end], start)
    return features(kind, before + span + text[end: end + AROUND], len(before), len(before) + len(span))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_CANDIDATE = T.StructType([*_SPAN.fields, T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("base", T.BooleanType()),
                           T.StructField("like", T.BooleanType()), T.StructField("plain", T.BooleanType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_CANDIDATE = pa.struct([*_ARROW_SPAN, ("x", pa.list_(pa.float64())), ("base", pa.bool_()), ("like", pa.bool_()),
                              ("plain", pa.bool_())])


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, base, candidates) of whole texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(_SPAN)),
                           T.StructField("candidates", T.ArrayType(_CANDIDATE))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, more = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text)
            found = [{"kind": kind, "start": a, "end": b, "x": example(kind, text, a, b), "base": True, "like": True, "plain": False}
                     for kind, a, b in spans]
            for kind, a, b in candidates(text):
                if not any(a < y and x < b for _, x, y in spans):
                    found.append({"kind": kind, "start": a, "end": b, "x": features(kind, text, a, b), "base": False, "like": False,
                                  "plain": known_plain(kind, text, a, b)})
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            more.append(found)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_ARROW_SPAN)), pa.array(more, pa.list_(_ARROW_CANDIDATE))],
                                          schema.names)

    return map_slices(rows, work, schema)


# ---------------------------------------------------------------- the trees

#: Share of the held-back examples above a threshold that must be personal data.
LEAST_PRECISION = 0.99
#: Steps of a score in which thresholds are sought.
STEPS = 1000


def _threshold(steps: dict[int, list[float]]) -> float:
    """The lowest score, 0.5 at least, above which the share of personal data holds; `steps` has (plain, personal) by step."""
    limit, plain, personal = STEPS, 0.0, 0.0
    for step in sorted(steps, reverse=True):
        plain, personal = plain + steps[step][0], personal + steps[step][1]
        if personal and personal >= LEAST_PRECISION * (plain + personal):
            limit = step
    return max(0.5, limit / STEPS)


def _fit(cands: DataFrame, seed: int = 7):
    """(model, thresholds by kind) from the examples, or None without both classes.

    Base spans in disguise are the examples of personal data, candidates known to be plain those of plain
    text; what is neither is judged without being an example.  Every example counts: three quarters fit the trees, a
    quarter is held back; there the threshold of each kind is the lowest score that keeps the precision.  A kind without held-back examples of both classes takes the threshold of all kinds.
    """
    known = cands.filter(F.col("base") | F.col("plain")).select(
        "kind", F.col("base").cast("double").alias("label"), "order", *[F.col("x")[k].alias(f) for k, f in enumerate(FEATURES)])
    known = durable(known, "examples")
    held = F.pmod(F.xxhash64("order"), F.lit(4)) == 0
    if known.select("label").distinct().count() < 2:
        return None
    # equal examples are one row with their number, so that the trees read no more rows than there are different ones
    train = durable(known.filter(~held).groupBy("label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight")), "train")
    if train.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=20, maxDepth=4, seed=seed, subsamplingRate=0.8, weightCol="weight").fit(assembled.transform(train))
    scored = model.transform(assembled.transform(known.filter(held))).select(
        "kind", "label", F.floor(vector_to_array("probability")[1] * STEPS).alias("step"))
    steps: dict[str | None, dict[int, list[float]]] = {k: {} for k in (None, *KINDS)}
    for r in scored.groupBy("kind", "label", "step").agg(F.count(F.lit(1)).alias("n")).collect():  # kinds, classes and steps bound it
        for k in (None, r["kind"]):
            steps[k].setdefault(r["step"], [0.0, 0.0])[int(r["label"])] += r["n"]
    both = lambda k: all(sum(x[c] for x in steps[k].values()) for c in (0, 1))
    return model, assembled, {k: _threshold(steps[k if both(k) else None]) for k in KINDS}


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): the fixed spans of every whole text and those that the trees add.

    Positions are code points, ends exclusive.  Null is read as empty; a text without candidates adds nothing;
    without examples of both classes no tree is fitted and nothing is added; an added span never equals a
    base span, and of added spans that overlap one of the same kind only the best scored stays.  Repeated
    rows stay repeated; other columns play no part.
    """
    rows = durable(_spans(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "spans")
    cands = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.*").withColumn(
        "order", F.xxhash64("row", "kind", "start", "end"))
    fitted = _fit(cands)
    none = F.array().cast(T.ArrayType(_SPAN))
    if fitted is None:
        return rows.select("doc_id", "base", none.alias("added"))
    model, assembled, thresholds = fitted
    open_ = cands.filter(~F.col("like")).select("row", "kind", "start", "end", *[F.col("x")[k].alias(f) for k, f in enumerate(FEATURES)])
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in thresholds.items()])
    chosen = model.transform(assembled.transform(open_)).select(
        "row", "kind", "start", "end", vector_to_array("probability")[1].alias("p")).filter(F.col("p") >= limit)
    added = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "kind", "start", "end"))).alias("found"))
    # best first; one that overlaps a better one of its kind is left out
    start = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    clash = lambda acc, s: F.exists(acc, lambda o: (o["kind"] == s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]))
    keep = F.aggregate("found", start, lambda acc, s: F.when(clash(acc, s), acc).otherwise(F.concat(acc, F.array(F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))))
    return rows.join(added.select("row", keep.alias("added")), "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    number = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(number(s).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = lambda spans: F.array_join(F.transform(order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        text(F.concat("base", "added")).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one names the whole."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])
