"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation estimates how far each
can be trusted, and a classifier of spans is trained on the labels that this gives.

Candidates are the base patterns (email, ip, card, phone; those that pass their checks always stay) and looser ones of further kinds. Every labeler votes
yes, no or nothing on every candidate. Votes and features are discrete, so all candidates of a corpus come down to a table of counts whose size
the kinds and features bound; estimation (a two-class model, one set of reliabilities per labeler and group of kinds) and training (logistic regression
on the estimated labels) run on that table. The trained weights go back as a column expression.

Only DataFrame functions and a few numbers on the driver; nothing of a document is shuffled. Candidates are written once, without the text. Patterns are possessive
and start only where a run starts, so that they take linear time on any text.

Defined results: null and empty texts have no spans, counts 0, empty `spans` and the digest of an empty string. Equal starts are ordered by kind. Repeated rows
are judged each. An empty table gives an empty result. Input columns named like a result are replaced; others but the text are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import keeping, settle
from wattloom.llm.spans import let, matches

# fixed values: the base kinds, in order, and the method's own
BASE = ("email", "ip", "card", "phone")
OWN = ("phone_local", "national_id", "iban", "person", "secret")
KINDS = BASE + OWN
# fixed values: lengths of the countries' account numbers
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# groups of four behind the check digits, and what is left of the country's length
_IBAN = "|".join(
    rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_LENGTHS.items()
)
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9A-Za-z+(.-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": rf"(?<![A-Z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_IBAN})|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{3,7}})(?![A-Z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Z0-9])|(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{8,}+)",
}
# what must stand in a text before its pattern is tried
SIGNS = {"email": "@", "phone": "+"}
GATES = {
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone_local": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]",
    "national_id": r"[0-9]{3}-[0-9]{2}-",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "person": r"(?:Mr|Ms|Mrs|Dr|Prof)\.?\x20[A-Z]",
    "secret": r"AKIA|assw|ecret|oken|[Aa]pi[_-]?[Kk]ey",
}
# fixed values: gazetteers of known good beginnings and endings, and of ranges that belong to nobody
GOOD = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|us|ca|it|nl|ch|at|pl|ru|cn|jp|in|br|au)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4[4-9])|35)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "phone_local": r"^\(?[2-9][0-8][0-9]",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:DE|FR|ES|GB|IT|NL|BE|CH|AT|PL|SE|DK|NO|FI|IE|PT|LU|CZ)",
    "person": r"\x20(?:Smith|Johnson|Brown|Jones|Miller|Davis|Garcia|Martinez|Wilson|Taylor|Martin|Lee|White|Clark|Lewis|Walker|Hall|Young|King|Wright|Müller|Schmidt|Weber|Dubois|Bernard|Moreau)$",
    "secret": r"^(?=[^0-9]*+[0-9])[^A-Za-z]*+[A-Za-z]",
}
NEAR_GOOD = r"(?i)(?:mail|contact|write|call|phone|tel|fax|mobile|reach|card|visa|payment|account|iban|bank|ssn|social|host|server|address|from|login|user|pass|key|name|signed)[^A-Za-z0-9]{0,4}(?:[a-z]{1,6}[^A-Za-z0-9]{0,3})?$"
NEAR_BAD = r"(?i)(?:version|ver|v|section|figure|fig|table|page|chapter|build|release|no|order|isbn|issn|doi|id|serial)[^A-Za-z0-9]{0,3}$"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"

ROUNDS = 25
PRIOR = 0.7
SURE = 0.5


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return s + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    """The checks of a base kind."""
    if kind == "ip":
        return found.rlike(IP_PARTS)
    if kind == "card":
        return let(_digits(found), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, m: Column) -> list[Column]:
    """Votes of the three labelers: 1 yes, -1 no, 0 nothing."""
    clean = ~F.coalesce(F.substring(m["before"], -1, 1), F.lit("")).rlike(r"[A-Za-z0-9]") & ~F.coalesce(F.substring(m["after"], 1, 1), F.lit("")).rlike(r"[A-Za-z0-9]")
    regex = F.when(clean, F.lit(1)).otherwise(F.lit(-1))
    gazetteer = F.when(m["found"].rlike(GOOD[kind]), F.lit(1)).otherwise(F.lit(0 if kind in ("person", "email") else -1))
    context = F.when(m["before"].rlike(NEAR_GOOD), F.lit(1)).when(m["before"].rlike(NEAR_BAD), F.lit(-1)).otherwise(F.lit(0))
    return [regex.alias("regex"), gazetteer.alias("gazetteer"), context.alias("context")]


def candidates(docs: DataFrame) -> DataFrame:
    """Adds `_spans`: array<struct<start, kind, end, base, regex, gazetteer, context, size>> in order, from `text`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_pii_text", text)
    text = F.col("_pii_text")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean,regex:int,gazetteer:int,context:int,size:int>>")
    parts = []
    for k, kind in enumerate(KINDS):
        gate = text.rlike(GATES[kind]) if kind in GATES else F.contains(text, F.lit(SIGNS[kind]))
        parts.append(F.when(gate, _kind_spans(k, kind, text)).otherwise(none))
    # one column per kind, so that no expression grows large
    df = df.select("*", *[p.alias(f"_pii_{k}") for k, p in zip(KINDS, parts)])
    both = F.array_sort(F.concat(*[F.col(f"_pii_{k}") for k in KINDS]))
    return df.withColumn("_spans", both).drop("_pii_text", *[f"_pii_{k}" for k in KINDS])


def _kind_spans(k: int, kind: str, text: Column) -> Column:
    def span(m: Column) -> Column:
        size = F.least(F.lit(3), F.floor(F.length(m["found"]) / 8)).cast("int")
        return F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), F.lit(kind in BASE).alias("base"), *_votes(kind, m), size.alias("size"))

    found = matches(text, F.lit(PATTERNS[kind]), 32)
    if kind in BASE:
        found = F.filter(found, lambda m: _passes(kind, m["found"]))
    return F.transform(found, span)


LABELERS = ("regex", "gazetteer", "context")


def estimate(cells: list[dict]) -> list[float]:
    """Probability of each cell of (kind, votes, n) being personal data, by expectation-maximisation of a two-class model.

    The classes start at a majority vote, which names them; each labeler has its chances of yes, no and nothing in each class, shared by the base kinds and by
    the others, and each kind has its prior. Chances are smoothed by one count.
    """
    p = [min(0.95, max(0.05, PRIOR + 0.2 * sum(c[x] for x in LABELERS))) for c in cells]
    for _ in range(ROUNDS):
        prior, chance = {}, {}
        for k in {c["kind"] for c in cells}:
            rows = [(q, c["n"]) for q, c in zip(p, cells) if c["kind"] == k]
            prior[k] = (sum(q * n for q, n in rows) + PRIOR) / (sum(n for _, n in rows) + 1)
        for group in (True, False):
            for x in LABELERS:
                for y in (0, 1):
                    weight = {v: 1.0 for v in (-1, 0, 1)}
                    for q, c in zip(p, cells):
                        if (c["kind"] < len(BASE)) == group:
                            weight[c[x]] += c["n"] * (q if y else 1 - q)
                    total = sum(weight.values())
                    chance.update({(group, x, y, v): w / total for v, w in weight.items()})
        p = []
        for c in cells:
            odds = math.log(prior[c["kind"]]) - math.log(1 - prior[c["kind"]])
            for x in LABELERS:
                at = (c["kind"] < len(BASE), x)
                odds += math.log(chance[(*at, 1, c[x])]) - math.log(chance[(*at, 0, c[x])])
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return p


def _names(c: dict) -> list[str]:
    """Features of a span: its kind, size, and each labeler's vote within its group of kinds."""
    return ["one", f"kind {c['kind']}", f"size {c['size']}", *[f"{x} {c[x]} {c['kind'] < len(BASE)}" for x in LABELERS]]


def train(cells: list[dict], p: list[float], rounds: int = 200, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic regression on estimated labels, by gradient steps scaled per feature; weights by feature name."""
    total = sum(c["n"] for c in cells) or 1
    w: dict[str, float] = {}
    size: dict[str, float] = {}
    for c in cells:
        for f in _names(c):
            w[f] = 0.0
            size[f] = size.get(f, 0.0) + c["n"] / total
    for _ in range(rounds):
        gradient = {f: -ridge * x for f, x in w.items()}
        for q, c in zip(p, cells):
            z = sum(w[f] for f in _names(c))
            e = (q - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * c["n"] / total
            for f in _names(c):
                gradient[f] += e
        for f in w:
            w[f] += gradient[f] / (size[f] + ridge)
    return w


def _score(weights: dict[str, float], s: Column) -> Column:
    def of(prefix: str, value: Column, values, suffix: str = "") -> Column:
        out = F.lit(0.0)
        for v in values:
            out = F.when(value == v, F.lit(weights.get(f"{prefix} {v}{suffix}", 0.0))).otherwise(out)
        return out

    base = s["kind"] < len(BASE)
    votes = [F.when(base, of(x, s[x], (-1, 0, 1), " True")).otherwise(of(x, s[x], (-1, 0, 1), " False")) for x in LABELERS]
    return sum(votes, F.lit(weights.get("one", 0.0)) + of("kind", s["kind"], range(len(KINDS))) + of("size", s["size"], range(4)))


def find(docs: DataFrame) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, joined by commas) and n_spans; drops the text."""
    return keeping(docs, ["text"], _found, ["text"])


def _found(kept: DataFrame) -> DataFrame:
    found = settle(candidates(kept).drop("text"), "pii-candidates")
    cell = ["kind", *LABELERS, "size"]
    counts = found.select(F.explode("_spans").alias("s")).select("s.*").groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = [r.asDict() for r in counts.orderBy(*cell).collect()]  # at most kinds x votes x sizes rows
    weights = train(cells, estimate(cells)) if cells else {}
    limit = math.log(SURE / (1 - SURE))
    stays = F.filter("_spans", lambda s: s["base"] | (_score(weights, s) >= limit))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter("_spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        *[F.col(f"`{c}`") for c in kept.columns if c != "text"],
        *[number(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(shown(base), 256).alias("base_sha256"), shown(stays).alias("spans"), F.size(stays).cast("long").alias("n_spans"),
    )
