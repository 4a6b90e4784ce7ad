"""Personal data by weak supervision, in DataFrame expressions only.

Four kinds have fixed patterns (the base). Wider patterns propose more spans; for every proposed span, labelers built on
its form, on small gazetteers and on the words before it vote yes, no or nothing. Expectation-maximisation over the counts
of vote patterns (a table bounded by kinds times 3 ** labelers) estimates each labeler's reliability without any labels,
and its posteriors train a logistic span classifier that every other span must pass. Base spans stay whatever it says.

A null or empty text has no spans (empty strings, zeros). Repeated rows are judged alike; a null doc_id is carried along.
An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import only

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("ssn", "iban", "name")

#: The contract's patterns. Possessive where what follows can't match the same characters, and an email is tried at the
#: start of a run of its characters only (or where the last match ended), so long runs take linear time.
BASE_PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must contain for the pattern to be tried at all.
NEEDS = ("@", ".", None, "+")

#: Wider proposals: kind and pattern.
PROPOSALS = (
    ("phone", r"(?<![0-9+.])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?(?![A-Za-z])"),
)

#: Gazetteers: country codes of account numbers, common given names, mail hosts.
COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
GIVEN_NAMES = ("Anna", "Carlos", "David", "Emma", "Hans", "James", "Jane", "Jean", "John", "Laura", "Maria", "Marie", "Mary", "Michael", "Paul", "Peter", "Robert", "Sarah", "Sophie", "Thomas")
MAIL_HOSTS = ("gmail", "yahoo", "hotmail", "outlook", "example", "proton", "icloud", "aol")
#: Words shortly before a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "email": "e-?mail|contact|write to|mailto",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|mastercard|credit|payment|pan",
    "phone": "phone|tel|call|fax|mobile|contact|cell",
    "ssn": r"ssn|social security|taxpayer|\btin\b",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "name": "dear|contact|signed|patient|from|by",
}
AGAINST = r"isbn|version|invoice|order no|part no|serial|model|figure|table|section|chapter"
LABELERS = ("form", "gazetteer", "context", "against", "plain")
SEP = "\u0001"


@dataclass(frozen=True)
class WeakParameters:
    rounds: int = 50
    #: Share of true spans among proposals before any vote is seen.
    prior: float = 0.5
    #: A proposed span is kept if the classifier gives it at least this.
    threshold: float = 0.6
    #: Characters before a span that the context labelers read.
    window: int = 40


def _count_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def luhn(m: Column) -> Column:
    """Whether the digits of m, doubled in every second place from the right, sum to a multiple of ten."""
    digits = F.transform(F.filter(F.split(F.reverse(F.regexp_replace(m, "[^0-9]", "")), ""), lambda c: c != ""), lambda c: c.cast("int"))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return _count_digits(m).between(16, 19) & luhn(m)
    if kind == "phone":
        return _count_digits(m).between(8, 15)
    return F.lit(True)


def _votes(kind: str, m: Column, before: Column) -> dict[str, Column]:
    """1 yes, -1 no, 0 nothing, of each labeler."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    form = {
        "email": vote(m.rlike(r"\.[A-Za-z]{2,}$"), ~m.rlike(r"\.[A-Za-z]{2,}$")),
        "ip": vote(m.rlike(r"^[1-9]"), m.rlike(r"^0|^(?:[0-9]\.){3}[0-9]$")),
        "card": vote(m.rlike("^[3-6]"), ~m.rlike("^[2-6]")),
        "phone": vote(m.rlike(r"^\+|^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]"), m.rlike(r"^\(?[01]")),
        "ssn": vote(~m.rlike("^(?:000|666|9)|-00-|-0000$"), m.rlike("^(?:000|666|9)|-00-|-0000$")),
        "iban": vote(_count_digits(m) >= 10, _count_digits(m) < 6),
        "name": vote(m.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]")),
    }[kind]
    gazetteer = {
        "email": vote(F.lower(m).rlike("@(?:[a-z0-9-]+\\.)*(?:" + "|".join(MAIL_HOSTS) + ")\\.")),
        "iban": vote(F.substring(m, 1, 2).isin(*COUNTRIES), ~F.substring(m, 1, 2).isin(*COUNTRIES)),
        "name": vote(m.rlike(r"\x20(?:" + "|".join(GIVEN_NAMES) + r")\b")),
    }.get(kind, F.lit(0))
    repeated = F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^0-9A-Za-z]", ""), ""))) <= 3
    return {"form": form, "gazetteer": gazetteer, "context": vote(before.rlike(CONTEXT[kind])), "against": vote(F.lit(False), before.rlike(AGAINST)), "plain": vote(~repeated, repeated)}


def _spans(text: Column, pattern: str, kind: str, base: bool, window: int) -> tuple[Column, Callable[[Column, Column], Column]]:
    """The pieces that the pattern's matches cut a text into, and the fold that makes (kind, start, end, base, votes) of them.

    Matches are fenced by a control character that no pattern matches; a piece at an odd place is then a match, and
    the lengths of the pieces before it give its place in code points.
    """
    clean = F.translate(text, SEP, "\u0002")
    pieces = F.split(F.regexp_replace(clean, f"({pattern})", f"{SEP}$1{SEP}"), SEP, -1)
    which = F.lit((KINDS + MORE_KINDS).index(kind))

    def step(acc: Column, i: Column) -> Column:
        gap, m = F.get("pieces", 2 * i), F.get("pieces", 2 * i + 1)
        start = acc["at"] + F.length(gap)
        votes = F.struct(*[v.cast("tinyint").alias(k) for k, v in _votes(kind, m, F.lower(F.right(gap, F.lit(window)))).items()])
        one = F.struct(which.alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.lit(base).alias("base"), votes.alias("votes"))
        ok = _passes(kind, m) if base else F.lit(True)
        return F.struct((start + F.length(m)).alias("at"), F.when(ok, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return pieces, step


EMPTY = "array<struct<kind:int,start:int,end:int,base:boolean,votes:struct<" + ",".join(f"{x}:tinyint" for x in LABELERS) + ">>>"


def candidates(docs: DataFrame, p: WeakParameters = WeakParameters()) -> DataFrame:
    """(doc_id, found): every base span and every proposal of each text; the text itself is left behind."""
    df = only(docs).withColumn("text", F.coalesce("text", F.lit("")))
    plan = [(kind, pattern, needs, True) for kind, pattern, needs in zip(KINDS, BASE_PATTERNS, NEEDS, strict=True)] + [(kind, pattern, None, False) for kind, pattern in PROPOSALS]
    none = F.array().cast(EMPTY)
    names = []
    for n, (kind, pattern, needs, base) in enumerate(plan):
        pieces, step = _spans(F.col("text"), pattern, kind, base, p.window)
        if needs is not None:
            pieces = F.when(F.col("text").contains(needs), pieces)
        # the pieces are a column of their own, so that the text is searched once
        df = df.withColumn("pieces", pieces)
        found = F.aggregate(F.sequence(F.lit(0), F.expr("(size(pieces) - 1) div 2 - 1").cast("int")), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        df = df.withColumn(f"__{n}", F.when(F.coalesce(F.size("pieces"), F.lit(0)) >= 3, found).otherwise(none)).drop("pieces")
        names.append(f"__{n}")
    return df.select("doc_id", F.concat(*names).alias("found"))


class Aggregator:
    """Reliabilities of the labelers by expectation-maximisation, and the classifier that the posteriors train."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...], int]], p: WeakParameters):
        """patterns: (kind, votes, count)."""
        k = len(LABELERS)
        self.prior = p.prior
        # P(vote | true) and P(vote | false), smoothed towards labelers that are right more often than not
        self.yes = [{-1: 0.1, 0: 0.4, 1: 0.5} for _ in range(k)]
        self.no = [{-1: 0.5, 0: 0.4, 1: 0.1} for _ in range(k)]
        start_yes, start_no = [dict(x) for x in self.yes], [dict(x) for x in self.no]
        for _ in range(p.rounds if patterns else 0):
            post = [self.posterior(v) for _, v, _ in patterns]
            mass = sum(q * n for q, (_, _, n) in zip(post, patterns, strict=True))
            total = sum(n for _, _, n in patterns)
            self.prior = min(0.98, max(0.02, (mass + p.prior) / (total + 1)))
            for j in range(k):
                for table, start, side in ((self.yes, start_yes, 1), (self.no, start_no, 0)):
                    seen = {x: 20 * start[j][x] for x in (-1, 0, 1)}
                    for q, (_, v, n) in zip(post, patterns, strict=True):
                        seen[v[j]] += n * (q if side else 1 - q)
                    whole = sum(seen.values())
                    table[j] = {x: seen[x] / whole for x in seen}
        self.weights = self._train(patterns)

    def posterior(self, votes: tuple[int, ...]) -> float:
        a, b = math.log(self.prior), math.log(1 - self.prior)
        for j, v in enumerate(votes):
            a += math.log(self.yes[j][v])
            b += math.log(self.no[j][v])
        return 1 / (1 + math.exp(min(700, b - a)))

    @staticmethod
    def features(kind: int, votes: tuple[int, ...]) -> list[float]:
        return [1.0, *[float(v == 1) for v in votes], *[float(v == -1) for v in votes], *[float(kind == i) for i in range(len(KINDS + MORE_KINDS))]]

    def _train(self, patterns: list) -> list[float]:
        rows = [(self.features(kind, v), self.posterior(v), math.log1p(n)) for kind, v, n in patterns]
        # the prior's own opinion of every single vote keeps unseen patterns in order
        for j in range(len(LABELERS)):
            for x in (-1, 1):
                v = tuple(x if i == j else 0 for i in range(len(LABELERS)))
                rows += [(self.features(-1, v), self.posterior(v), 1.0)]
        size = len(rows[0][0])
        w, g2 = [0.0] * size, [1e-8] * size
        total = sum(n for *_, n in rows)
        for _ in range(300):
            g = [1e-3 * x for x in w]
            for x, t, n in rows:
                e = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - t) * n / total
                for i, a in enumerate(x):
                    g[i] += e * a
            for i in range(size):
                g2[i] += g[i] * g[i]
                w[i] -= 0.3 * g[i] / math.sqrt(g2[i])
        return w

    def margin(self, kind: Column, votes: Column) -> Column:
        k, w = len(LABELERS), self.weights
        out = F.lit(w[0])
        for j, name in enumerate(LABELERS):
            out = out + F.when(votes[name] == 1, w[1 + j]).when(votes[name] == -1, w[1 + k + j]).otherwise(0.0)
        return out + F.element_at(F.array(*[F.lit(x) for x in w[1 + 2 * k :]]), kind + 1)


def aggregator(found: DataFrame, p: WeakParameters = WeakParameters()) -> Aggregator:
    votes = found.select(F.explode("found").alias("s")).groupBy("s.kind", *[F.col(f"s.votes.{x}").alias(x) for x in LABELERS]).count()
    return Aggregator(sorted((r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in votes.collect()), p)


def detect(docs: DataFrame, p: WeakParameters = WeakParameters()) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), sorted."""
    found = stored(candidates(docs, p))
    model = aggregator(found, p)
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("found", lambda s: s["base"]), bare)
    good = lambda s: (1 / (1 + F.exp(-model.margin(s["kind"], s["votes"])))) >= p.threshold
    more = F.transform(F.filter("found", lambda s: ~s["base"] & good(s) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))), bare)
    return found.withColumn("base", base).select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.array_distinct(F.concat("base", more))).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS + MORE_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, p: WeakParameters = WeakParameters()) -> DataFrame:
    """One row per document, for the query."""
    # a filter's function of two arguments gets the place as well, so each kind is bound outside it
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return detect(docs, p).select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
