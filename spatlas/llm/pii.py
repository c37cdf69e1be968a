"""Personal data and secrets: base patterns, and bootstrapped contextual extraction.

One scan finds the base spans (e-mail, IP, card, phone), secrets of published formats or behind a label, and the
identifier-like strings beside them, each with its patterns: the one and two words before it, the word after it, and for secrets the shape. Base
spans and known secrets are the seeds. A second scan counts how often the seeds' contexts occur at all. Spark then scores the graph of
patterns and instances in rounds until nothing moves: a pattern is as good as the share of its occurrences, other words
included, that hold known instances; an instance is as good as the best pattern that holds it, and those that are
more likely than not support further patterns. High-confidence patterns turn the strings they hold into spans."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatlas.llm.common import LOWER_NAMES, U64, mix, row_uid, signed, text_chunks, words_of
from spatlas.llm.winnowing import _bit_table, _in_table
from spatlas.storage import stored

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: A start within a run of digits can't succeed where the run's own start fails, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs of adjacent digit groups, and strings that could be a secret.
GROUPS = re.compile(r"(?<![A-Za-z0-9_])\+?[0-9](?:[\x20()./-]{0,2}[0-9])*(?![A-Za-z0-9_])")
OPAQUE = re.compile(r"[A-Za-z0-9_+/-]{12,}")
DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: Key formats that their issuers publish, and words that label a secret.
FORMATS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{24,}")
LABELS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key")
LABELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(LABELS)})[\"']?[\x20\t]{{0,3}}[=:][\x20\t]{{0,3}}[\"']?([^\s\"'<>]{{8,}})", re.IGNORECASE)
EDGE = "\"'()[]{}<>,;:.!?%$&*#|="
#: Words of patterns: runs of letters, digits, underscores and everything beyond ASCII; their digits count as one.
IS_PART = np.zeros(256, bool)
IS_PART[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
PART = re.compile("[0-9A-Za-z_\x80-\U0010ffff]+")
NAMES = LOWER_NAMES.copy()
NAMES[48:58] = NAMES[48]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @, so the leftmost match is that of the first @ with both sides; linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255" for p in m[0].split("."))]
        spans += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= m.end() - m.start() and 13 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return spans


def shape(token: str) -> str:
    """What a secret is made of, and its length."""
    kinds = "hex" if re.fullmatch("[0-9a-f]+", token) else "upper" if re.fullmatch("[0-9A-Z]+", token) else "mixed"
    return f"{kinds}{len(token)}"


def known_secrets(text: str) -> list[tuple[int, int]]:
    """Places of strings of a published format, or of at least 8 characters and a digit behind a label; those that overlap an earlier one are left out."""
    found = [m.span() for m in FORMATS.finditer(text) if not (m.start() and text[m.start() - 1].isalnum()) and not text[m.end() : m.end() + 1].isalnum()]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(label in low for label in LABELS):
            for m in LABELLED.finditer(text):
                token = m[1].rstrip(EDGE)
                if len(token) >= 8 and DIGIT.search(token):
                    found.append((m.start(1), m.start(1) + len(token)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def identifiers(text: str) -> list[tuple[tuple[str, ...], int, int]]:
    """Strings that could be an identifier of some kinds, without the punctuation around them."""
    found = []
    at = text.find("@")
    free = 0
    while at >= 0:
        begin, end = at, at + 1
        while begin > free and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace() and text[end] != "@":
            end += 1
        free = end
        token = text[begin:end]
        a, b = begin + len(token) - len(token.lstrip(EDGE)), end - len(token) + len(token.rstrip(EDGE))
        if a < at < b - 1:
            found.append((("email",), a, b))
        at = text.find("@", end)
    if DIGIT.search(text):
        for m in GROUPS.finditer(text):
            digits = len(DIGIT.findall(m[0]))
            kinds = [k for k, fits in (("ip", DOTTED.fullmatch(m[0])), ("card", 12 <= digits <= 19), ("phone", 7 <= digits <= 15)) if fits]
            if kinds:
                found.append((tuple(kinds), *m.span()))
        for m in OPAQUE.finditer(text):
            digits = len(DIGIT.findall(m[0]))
            if digits >= 2 and sum(map(str.isalpha, m[0])) >= 2:
                found.append((("secret",), *m.span()))
    return found


# ---------------------------------------------------------------- patterns
def _one(tag: int, h: np.ndarray) -> np.ndarray:
    return mix(h + U64(tag))


def _two(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix(_one(2, h) * U64(3) + g)


def _shape_print(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)


def _word(text: str, place: tuple[int, int]) -> str:
    word = DIGIT.sub("0", text[slice(*place)].lower())
    return word if len(word) <= 40 else hashlib.blake2b(word.encode(), digest_size=10).hexdigest()


def patterns(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[str, int]]]:
    """For each span its patterns, as text and as fingerprint: ``w *`` and ``v w *`` of the words before it, ``* w`` of the word after."""
    places = [m.span() for m in PART.finditer(text)]
    starts, ends = [a for a, _ in places], [b for _, b in places]
    data = text.encode()
    h, _ = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), IS_PART, NAMES)
    out = []
    for a, b in spans:
        left, right, found = bisect_right(ends, a) - 1, bisect_left(starts, b), []
        if left >= 0:
            found.append((f"{_word(text, places[left])} *", int(signed(_one(1, h[left : left + 1]))[0])))
        if left >= 1:
            found.append((f"{_word(text, places[left - 1])} {_word(text, places[left])} *", int(signed(_two(h[left - 1 : left], h[left : left + 1]))[0])))
        if right < len(places):
            found.append((f"* {_word(text, places[right])}", int(signed(_one(3, h[right : right + 1]))[0])))
        out.append(found)
    return out


_OCCURRENCE = pa.struct([("kind", pa.string()), ("seed", pa.bool_()), ("instance", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.struct([("pattern", pa.string()), ("fp", pa.int64())])))])
SCANNED = "doc_id long, uid long, base array<string>, found array<struct<kind:string,seed:boolean,instance:string,start:long,end:long,patterns:array<struct<pattern:string,fp:long>>>>"


def _outside(taken: list[tuple[int, int]]):
    """Tells whether a span overlaps none of ``taken``."""
    taken = sorted(taken)
    reach = list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        at = bisect_left(taken, (b, 0))
        return at == 0 or reach[at - 1] <= a

    return free


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Base spans and known secrets as seeds, and other identifier-like strings that overlap none of them."""
    rows = [(k, True, a, b) for k, a, b in base]
    free = _outside([(a, b) for _, a, b in base])
    rows += [("secret", True, a, b) for a, b in known_secrets(text) if free(a, b)]
    free = _outside([(a, b) for _, _, a, b in rows])
    rows += [(k, False, a, b) for kinds, a, b in identifiers(text) if free(a, b) for k in kinds]
    if not rows:
        return []
    instance = lambda t: t if len(t) <= 200 else hashlib.blake2b(t.encode(), digest_size=16).hexdigest()
    out = []
    for (kind, seed, a, b), found in zip(rows, patterns(text, [(a, b) for _, _, a, b in rows]), strict=True):
        if kind == "secret":
            found = [*found, (f"<{shape(text[a:b])}>", _shape_print(shape(text[a:b])))]
        out.append({"kind": kind, "seed": seed, "instance": instance(text[a:b].lower()), "start": a, "end": b, "patterns": [{"pattern": p, "fp": f} for p, f in found]})
    return out


def _scan(batches):
    for batch in batches:
        base, found = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            spans = base_spans(text)
            base.append([f"{k}:{a}:{b}" for k, a, b in spans])
            found.append(occurrences(text, spans) if spans or "@" in text or DIGIT.search(text) else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(base, pa.list_(pa.string())), pa.array(found, pa.list_(_OCCURRENCE))], names=["doc_id", "uid", "base", "found"])


def _count(bits):
    def count(batches):
        """(fp, n): occurrences of words and pairs of words as contexts, of those that may be a seed's; a row a batch and pattern."""
        for batch in batches:
            parts = []
            for i, j, data, offsets in text_chunks(batch.column("text")):
                h, begin = words_of(data, offsets, IS_PART, NAMES)
                for r in range(j - i):
                    w = h[begin[r] : begin[r + 1]]
                    if len(w) > 1:
                        every = np.concatenate([_one(1, w[:-1]), _two(w[:-2], w[1:-1]), _one(3, w[1:])])
                        parts.append(every[_in_table(bits.value, every)])
            fp, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(fp)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    return count


def pattern_totals(documents: DataFrame, found: DataFrame, least_seeds: int) -> DataFrame:
    """(fp, total): how often the patterns of at least ``least_seeds`` seeds occur in all texts, whatever they hold; shapes, among all strings found.

    The scan knows the patterns by 2 MB of bits, however many they are."""
    seeds = found.where("seed").groupBy("kind", "fp").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= least_seeds)
    hopeful = stored(seeds.select("fp").distinct(), "pii-hopeful")
    bits = documents.sparkSession.sparkContext.broadcast(_bit_table(hopeful))
    words = documents.select("text").mapInArrow(_count(bits), "fp long, n long")
    shapes = found.where("pattern LIKE '<%'").groupBy("fp").agg(F.count("*").alias("n"))
    return stored(words.union(shapes).groupBy("fp").agg(F.sum("n").alias("total")).join(hopeful, "fp"), "pii-totals")


def score_patterns(found: DataFrame, totals: DataFrame, least_seeds: int = 3, rounds: int = 20) -> DataFrame:
    """(kind, pattern, fp, confidence, support) once no score moves, or after some rounds.

    ``found`` has kind, seed, instance, pattern and fp, a row for each occurrence and pattern; ``totals`` (fp, total). Edges are counted
    before anything is joined, so a hot pattern or instance is a few combined rows a task; each round is stored. Scores only grow, and
    are rounded so that the order of sums can't show. Patterns have at least ``least_seeds`` seeds for a start; discovered
    instances of a score above a half count as support beside them."""
    edges = found.groupBy("kind", "fp", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.min("pattern").alias("pattern"))
    edges = stored(edges.join(totals, "fp"), "pii-edges")
    scores = stored(edges.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("score")), "pii-scores")
    while True:
        support = F.count_if(F.col("score") > 0.5).alias("support")
        confidence = F.least(F.lit(1.0), F.round(F.sum(F.col("n") * F.col("score")) / (F.first("total") + 1), 6)).alias("confidence")
        patterns = stored(edges.join(scores, ["kind", "instance"]).groupBy("kind", "fp").agg(F.min("pattern").alias("pattern"), confidence, support).where(F.col("support") >= least_seeds), "pii-patterns")
        rounds -= 1
        held = edges.join(patterns.select("kind", "fp", "confidence"), ["kind", "fp"]).groupBy("kind", "instance").agg(F.max("confidence").alias("held"))
        new = scores.join(held, ["kind", "instance"], "left").select("kind", "instance", F.greatest("score", F.coalesce("held", F.lit(0.0))).alias("score"), "score")
        new = stored(new.toDF("kind", "instance", "score", "old"), "pii-scores")
        if rounds <= 0 or not new.where("score > old").limit(1).count():
            return patterns
        scores = new.drop("old")


def find_pii(documents: DataFrame, confidence: float = 0.8, least_seeds: int = 3, rounds: int = 20) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, uid, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added, n_found.

    The counts by kind and base_sha256 are of base spans; ``spans`` has all: base spans, secrets, and what sure patterns add. n_secret counts
    secrets, n_added all beyond the base, n_found all. Places are code points, ends exclusive. A null text is empty. A string
    that several kinds' patterns claim is a span of each; added spans overlap no base span. Repeated rows get equal results;
    other columns aren't read; an empty table gives an empty result."""
    docs = documents.select(F.col("doc_id").cast("long"), "text", row_uid().alias("uid"))
    scanned = stored(docs.mapInArrow(_scan, SCANNED), "pii-scan")
    every = scanned.where("size(found) > 0").select("doc_id", "uid", F.explode("found").alias("f")).select("doc_id", "uid", "f.*")
    found = stored(every.select("kind", "seed", "instance", F.explode("patterns").alias("p")).select("kind", "seed", "instance", "p.*"), "pii-patterns")
    sure = score_patterns(found, pattern_totals(docs, found, least_seeds), least_seeds, rounds).where(F.col("confidence") >= confidence).select("kind", "fp").withColumn("sure", F.lit(True))
    # a base span is there already; a known secret stands without a pattern
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    others = every.where(f"NOT seed OR kind NOT IN ({', '.join(map(repr, BASE_KINDS))})").select("doc_id", "uid", "kind", "seed", span.alias("span"), F.explode_outer("patterns.fp").alias("fp"))
    added = others.join(sure, ["kind", "fp"], "left").where("seed OR sure").groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(F.collect_set("span").alias("added"))
    joined = scanned.join(added, scanned.doc_id.eqNullSafe(added.d) & (scanned.uid == added.u), "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    rank = f"array_position(array({', '.join(map(repr, KINDS))}), split(s, ':')[0])"
    ordered = F.expr(f"transform(sort_array(transform(concat(base, added), s -> struct({rank} AS k, cast(split(s, ':')[1] AS long) AS a, s AS s))), x -> x.s)")
    count = [F.expr(f"cast(size(filter(base, s -> s LIKE '{k}:%')) AS long)").alias(f"n_{k}") for k in BASE_KINDS]
    return joined.select(
        "doc_id", "uid", *count, F.sha2(F.concat_ws(",", "base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", ordered).alias("spans"),
        F.expr("cast(size(filter(added, s -> s LIKE 'secret:%')) AS long)").alias("n_secret"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_found"),
    )


def base_row(text: str | None) -> tuple:
    """The base columns of one text, for tests and single uses."""
    spans = base_spans(text or "")
    return *(sum(k == kind for k, _, _ in spans) for kind in BASE_KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
