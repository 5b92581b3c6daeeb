"""The sanitisation gate: detectors, verdicts, policy, masking, and a hash-chained ledger."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selvage.config import SENSITIVE
from selvage.functions.digest import canonical, hmac_sha256, token

#: Patterns of the detectors, in ASCII classes so that every regular expression engine reads them alike.
PATTERNS = {
    "ni-number": r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}[0-9]{6}[A-D]\b",
    "us-ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "card-pan": r"\b(?:[0-9][ -]?){13,19}\b",
    "uk-postcode": r"(?i)\b[A-Z]{1,2}[0-9][A-Z0-9]?[ \t\r\n]?[0-9][A-Z]{2}\b",
    "us-zip4": r"\b[0-9]{5}-[0-9]{4}\b",
    "email": r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b",
    "e164-phone": r"\+[1-9][0-9]{6,14}\b",
}
TITLE_CASE = r"(?:[A-Z][a-z]+|[A-Z]\.)(?:[ \t\r\n]+(?:[A-Z][a-z]+|[A-Z]\.))+"
LEXICON = r"(?i)\b(" + "|".join(SENSITIVE) + r")\b"
BIRTH = r"(?i)\b(?:date of birth|dob|born|birthdate)\b"
DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b"
BIRTH_WINDOW = 40
BLOCKING, MASKING = ("PERSONAL_DATA", "SENSITIVE_DOMAIN"), ("IDENTIFYING", "SAMPLE_VALUE")
_SPAN = "array<struct<rung:string,label:string,value:string,detector:string>>"


def matches(text: Column, detector: str) -> Column:
    """All matches of a pattern; card numbers must pass the checksum."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[detector]), F.lit(0))
    if detector == "card-pan":
        found = F.filter(found, lambda v: F.call_function("luhn_check", F.regexp_replace(v, "[ -]", "")))
    return found


def births(text: Column) -> Column:
    """The first date near each mention of a birth: within BIRTH_WINDOW characters on either side of the mention.

    The text before each mention is what precedes it among the parts between mentions; positions are sums of lengths.
    """
    parts, said = F.split(text, BIRTH), F.regexp_extract_all(text, F.lit(BIRTH), F.lit(0))

    def near(word: Column, i: Column) -> Column:
        ahead = F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda s, p: s + F.length(p))
        start = ahead + F.aggregate(F.slice(said, F.lit(1), i), F.lit(0), lambda s, w: s + F.length(w))
        first = F.greatest(start - BIRTH_WINDOW, F.lit(0))
        window = F.substring(text, first + 1, start - first + F.length(word) + BIRTH_WINDOW)
        return F.regexp_extract(window, DATE, 0)

    return F.filter(F.transform(said, near), lambda v: v != "")


def spans(prose: Column, structural: Column | None = None, examples: Column | None = None) -> Column:
    """Everything found in one text: rung, label, value, detector.

    structural and examples are arrays of texts by their place in a structured document; a flat text is prose.
    """

    def every(values: Column, rung: str, label: str, detector: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(rung).alias("rung"), F.lit(label).alias("label"), v.alias("value"), F.lit(detector).alias("detector")))

    found = [every(matches(prose, d), "L1", "IDENTIFYING", d) for d in PATTERNS]
    found += [every(births(prose), "L1", "IDENTIFYING", "dob-in-context"), every(F.regexp_extract_all(prose, F.lit(TITLE_CASE), F.lit(0)), "L2", "IDENTIFYING", "title-case-sequence")]
    found += [every(F.regexp_extract_all(prose, F.lit(LEXICON), F.lit(0)), "L4", "SENSITIVE_DOMAIN", "sensitive-domain-lexicon")]
    if structural is not None:
        found.insert(0, every(structural, "L0", "STRUCTURAL", "structural-position"))
    if examples is not None:
        found.append(every(examples, "L3", "SAMPLE_VALUE", "example-literal"))
    return F.coalesce(F.concat(*found), F.array().cast(_SPAN))


def labels(spans_: Column, has_prose: Column) -> Column:
    """Distinct labels, sorted; DOCUMENTARY too where there is prose or nothing was found."""
    own = F.array_distinct(F.transform(spans_, lambda s: s["label"]))
    return F.array_sort(F.when(has_prose | (F.size(own) == 0), F.array_union(own, F.array(F.lit("DOCUMENTARY")))).otherwise(own))


def verdict(labels_: Column) -> Column:
    """block, mask or allow by the gravest label."""
    any_of = lambda names: F.arrays_overlap(labels_, F.array(*[F.lit(n) for n in names]))
    return F.when(any_of(BLOCKING), "block").when(any_of(MASKING), "mask").otherwise("allow")


def hits(spans_: DataFrame) -> DataFrame:
    """Counts by rung and detector of rows with an array column `spans`."""
    each = spans_.select(F.explode("spans").alias("s"))
    return each.groupBy(F.col("s.rung").alias("rung"), F.col("s.detector").alias("detector")).agg(F.count("*").alias("n"))


# --- policy --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A rule of the egress policy: all its conditions must hold. None: no such condition."""

    id: str
    verdict: str
    all_in: tuple[str, ...] | None = None
    any_in: tuple[str, ...] | None = None
    licence_in: tuple[str, ...] | None = None
    all_masked: bool | None = None
    reason: str | None = None

    def holds(self, labels_: Column, licence: Column, masked: Column) -> Column:
        names = lambda v: F.array(*[F.lit(x) for x in v])
        out = F.lit(True)
        if self.all_in is not None:
            out &= F.size(F.array_except(labels_, names(self.all_in))) == 0
        if self.any_in is not None:
            out &= F.arrays_overlap(labels_, names(self.any_in))
        if self.licence_in is not None:
            out &= licence.isin(*self.licence_in)
        if self.all_masked is not None:
            out &= masked == F.lit(self.all_masked)
        return out


def load_rules(text: str) -> tuple[int, tuple[Rule, ...]]:
    """Version and rules of a policy written as JSON: {"version": n, "rules": [{"id", "verdict", and a rule's conditions}]}."""
    document = json.loads(text)
    known = {f.name for f in fields(Rule)}
    rules = []
    for r in document["rules"]:
        if extra := set(r) - known:
            raise ValueError(f"unknown condition {min(extra)}")
        if r.get("verdict") not in ("allow", "block"):
            raise ValueError(f"rule {r.get('id')} must allow or block")
        rules.append(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}))
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    return int(document["version"]), tuple(rules)


POLICY_VERSION = 3
RULES = (
    Rule("allow-structural", "allow", all_in=("STRUCTURAL",)),
    Rule("allow-documentary-masked", "allow", all_in=("STRUCTURAL", "DOCUMENTARY", "IDENTIFYING", "SAMPLE_VALUE"), all_masked=True),
    Rule("block-personal", "block", any_in=BLOCKING, reason="Personal or special-category data never crosses a border."),
    Rule("block-unlicensed", "block", licence_in=("prohibited", "unknown"), reason="Licence disposition must be recorded as permitted before ingestion."),
)


def policy(labels_: Column, licence: Column, masked: Column, approved: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict, reason): any rule that blocks beats any that allows, then an approved exception, then the
    default, which is to block."""
    struct = lambda rule, what, why: F.struct(F.lit(rule).alias("rule"), F.lit(what).alias("verdict"), F.lit(why).cast("string").alias("reason"))
    order = [r for r in rules if r.verdict == "block"] + [r for r in rules if r.verdict == "allow"]
    out = None
    for r in order:
        hit = r.holds(labels_, licence, masked)
        out = F.when(hit, struct(r.id, r.verdict, r.reason)) if out is None else out.when(hit, struct(r.id, r.verdict, r.reason))
    if approved is not None:
        out = out.when(approved, struct("dpo-approved-exception", "allow", None))
    return out.otherwise(struct("default", "block", "no rule matches"))


def exclusion(rule: Column) -> Column:
    return F.when(rule == "block-unlicensed", "licence-blocked").otherwise("policy-blocked")


# --- masking -------------------------------------------------------------------------------------------------------------


def redact(text: Column, spans_: Column, key: bytes) -> Column:
    """The text with the value of every L1 to L3 span replaced by its keyed token, longest first (ties by value, label)."""
    own = F.filter(spans_, lambda s: s["rung"].isin("L1", "L2", "L3") & (s["value"] != ""))
    order = F.array_sort(F.array_distinct(F.transform(own, lambda s: F.struct((-F.length(s["value"])).alias("n"), s["value"].alias("value"), s["label"].alias("label")))))
    return F.aggregate(order, text, lambda acc, s: F.replace(acc, s["value"], token(key, s["label"], s["value"])))


def classify(documents: DataFrame, key: bytes, text: str = "text", licence: Column | None = None, approved: Column | None = None) -> DataFrame:
    """documents with spans, labels, verdict, rule, exclusion, output (masked, null if blocked or if a masked value is
    still there) and residual (whether one is). A null text has no spans and is allowed as documentary."""
    prose = F.coalesce(F.col(text), F.lit(""))
    out = documents.withColumn("spans", spans(prose)).withColumn("labels", labels(F.col("spans"), prose != ""))
    out = out.withColumn("policy", policy(F.col("labels"), F.lit("permitted") if licence is None else licence, F.lit(True), approved))
    gate = F.when((F.col("policy.verdict") == "block"), "block").otherwise(verdict(F.col("labels")))
    out = out.withColumn("verdict", gate).withColumn("exclusion", F.when(F.col("verdict") == "block", exclusion(F.col("policy.rule"))))
    masked = F.when(F.col("verdict") == "block", F.lit(None)).otherwise(redact(prose, F.col("spans"), key))
    residual = F.exists("spans", lambda s: s["rung"].isin("L1", "L2", "L3") & F.contains(F.col("output"), s["value"]))
    out = out.withColumn("output", masked).withColumn("residual", F.coalesce(residual, F.lit(False)))
    return out.withColumn("output", F.when(~F.col("residual"), F.col("output")))


# --- ledger --------------------------------------------------------------------------------------------------------------


def chain(entries: DataFrame, region: str, order: list[str], fields: dict[str, Column], key: bytes | None = None, stored: DataFrame | None = None) -> DataFrame:
    """region, seq, entryId, body, prevHash, hash (and signature): entries chained in their region, each hash over the hash
    before it and the entry's canonical JSON. stored(region, seq, hash): a chain that they continue.

    A chain is sequential by nature. Regions run in parallel; each is sorted and streamed with the last hash as its only
    state, so a task holds one batch of a region, however long its chain is.
    """
    body = canonical(**fields)
    rows = entries.select(F.col(region).cast("string").alias("region"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], body.alias("body"))
    tail = F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("hash"))
    if stored is None:
        rows = rows.withColumn("tail", tail)
    else:
        tails = stored.groupBy(F.col("region").cast("string").alias("region")).agg(F.max(F.struct(F.col("seq").cast("bigint").alias("seq"), "hash")).alias("last"))
        rows = rows.join(tails, "region", "left").withColumn("tail", F.coalesce("last", tail))
    sorted_ = rows.repartition("region").sortWithinPartitions("region", *[f"o{i}" for i in range(len(order))]).select("region", "body", F.col("tail.seq").alias("from_seq"), F.col("tail.hash").alias("from_hash"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, last = None, 0, None
        for frame in frames:
            out = []
            for r, b, from_seq, from_hash in zip(frame["region"], frame["body"], frame["from_seq"], frame["from_hash"]):
                if r != now:
                    now, seq, last = r, int(from_seq), from_hash
                seq += 1
                entry = f"ledger-{r}-{seq:06d}"
                digest = hashlib.sha256(f"{last or 'null'}|{entry}|{b}".encode()).hexdigest()
                out.append((r, seq, entry, b, last, digest))
                last = digest
            yield pd.DataFrame(out, columns=["region", "seq", "entryId", "body", "prevHash", "hash"])

    out = sorted_.mapInPandas(run, "region string, seq bigint, entryId string, body string, prevHash string, hash string")
    return out if key is None else out.withColumn("signature", hmac_sha256(key, F.col("hash")))


def verify(ledger: DataFrame, region: str = "region", key: bytes | None = None) -> DataFrame:
    """The ledger's rows that break the chain: a wrong predecessor, hash, number or signature."""
    own = W.partitionBy(region).orderBy("seq")
    before = F.lag("hash").over(own)
    expected = F.sha2(F.concat(F.coalesce(F.col("prevHash"), F.lit("null")), F.lit("|"), F.col("entryId"), F.lit("|"), F.col("body")), 256)
    bad = ~F.col("prevHash").eqNullSafe(before) | (F.col("hash") != expected) | (F.col("seq") != F.row_number().over(own))
    if key is not None:
        bad |= ~F.col("signature").eqNullSafe(hmac_sha256(key, F.col("hash")))
    return ledger.withColumn("bad", bad).where("bad").drop("bad")
