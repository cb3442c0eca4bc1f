"""Personal data by weak supervision. DataFrame and SQL functions only.

Candidates of every kind are voted on by labelers: the regex labeler (does the kind's own check hold; for other forms
the check of their number plan, or of an account number's remainder), a gazetteer (top-level domains, reserved networks, card
prefixes, calling codes, countries of account numbers and their lengths, numbers that are published examples), a context
labeler (cue words before the span) and a boundary labeler. Votes are 1, -1 or 0 (abstains). Expectation-maximisation estimates per kind how
often each labeler is right; it needs only how often each pattern of votes occurs, a table of at most
kinds x 3^labelers rows, whatever the corpus. Its posteriors then train the final span classifier, naive Bayes over
bounded features of the span (kind, votes, length, digits, separators), again from sums by feature value.

Spans of the four base kinds that pass their checks always stay. The method adds spans of kind ``other``
(national phone numbers, social security forms, account numbers, and base forms that failed their check) that the
classifier takes for personal data and that overlap no base span.

Defined results: null text is empty text without spans; a null id stays null; rows that repeat id and text each get the same
result, rows that share an id with other texts each their own; spans that two forms share are listed once; texts of any length
are taken whole, in time that grows with their length; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .native import listed, quoted, spans

# Possessive forms of the patterns and starts tied to where a run begins (or the last match ended) keep long runs
# linear; the spans are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OTHER = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?"
KINDS = ("email", "ip", "card", "phone", "other")
LABELERS = ("regex", "gazetteer", "context", "boundary")
ROUNDS, PRIOR, THRESHOLD = 25, 0.5, 0.5

# Gazetteers and cue words.
CUES = "mail|e-mail|email|contact|phone|tel|call|fax|mobile|reach|card|visa|credit|account|iban|address|host|ip|ssn|social"
AGAINST = "version|isbn|invoice|order|page|figure|chapter|section|total|price"
CARD_PREFIX = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CALLING = "^\\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_NET = "^(0|10|127|169\\.254|172\\.(1[6-9]|2[0-9]|3[01])|192\\.0\\.[02]|192\\.168|198\\.(1[89]|51\\.100)|203\\.0\\.113|22[4-9]|23[0-9]|24[0-9]|25[0-5])\\."
TOP_DOMAINS = (
    "com org net edu gov mil int info biz name pro coop aero museum mobi jobs travel cat tel asia post app dev online site shop store blog cloud email tech xyz "
    "ac ae ar at au be bg br ca ch cl cn co cr cy cz de dk ec ee eg es eu fi fr gr hk hr hu id ie il in io ir is it jp ke kr lt lu lv ma me mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tn tr tv tw ua uk us uy ve vn za"
).split()
#: Length of account numbers by country.
IBAN = dict(
    x.split(":") for x in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 "
        "JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
#: Social security numbers that are published examples, and the lines kept for fiction.
EXAMPLES, FICTION = "078-05-1120|219-09-9999|457-55-5462", "55501[0-9]{2}$"
COUNTRY, SOCIAL, PLAN = "^[A-Z]{2}[0-9]{2}", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "^[2-9][0-8][0-9][2-9][0-9]{6}$"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _octets(x: str) -> str:
    part = "regexp_replace(p, '^0+(?=.)', '')"
    return f"forall(split({x}, '[.]'), p -> length({part}) <= 3 AND CAST({part} AS INT) <= 255)"


#: SQL checks of a match ``x.v``, by kind.
CHECKS = (
    "true",
    _octets("x.v"),
    f"length({_digits('x.v')}) BETWEEN 12 AND 19 AND luhn_check({_digits('x.v')})",
    f"length({_digits('x.v')}) BETWEEN 9 AND 15",
    "false",
)


def _remainder(x: str) -> str:
    """SQL of an account number's remainder by 97, with its first four signs moved to the end and letters as numbers."""
    v = f"replace({x}, ' ', '')"
    return f"aggregate(split(concat(substr({v}, 5), left({v}, 4)), ''), 0, (a, c) -> CASE WHEN c RLIKE '[0-9]' THEN (a * 10 + CAST(c AS INT)) % 97 WHEN c = '' THEN a ELSE (a * 100 + ascii(c) - 55) % 97 END)"


#: SQL: whether another form can be what it looks like by its own rules, and what the gazetteer says of it.
OTHER_HOLDS = f"""CASE WHEN x.v RLIKE {quoted(COUNTRY)} THEN {_remainder('x.v')} = 1
    WHEN x.v RLIKE {quoted(SOCIAL)} THEN NOT (x.v RLIKE '^(000|666|9)' OR substr(x.v, 5, 2) = '00' OR right(x.v, 4) = '0000') ELSE {_digits('x.v')} RLIKE {quoted(PLAN)} END"""
OTHER_KNOWN = f"""CASE WHEN x.v RLIKE {quoted(COUNTRY)} THEN IF(element_at(map({', '.join(f"'{k}', {n}" for k, n in IBAN.items())}), left(x.v, 2)) <=> length(replace(x.v, ' ', '')), 1, -1)
    WHEN x.v RLIKE {quoted(SOCIAL)} THEN IF(x.v RLIKE {quoted(EXAMPLES)}, -1, 0) ELSE IF({_digits('x.v')} RLIKE {quoted(FICTION)}, -1, 0) END"""


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(f"coalesce(CAST({text_col} AS STRING), '')").alias("text"))
    found = found.select("doc_id", F.xxhash64("text").alias("key"), *[spans("text", p).alias(k) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE, OTHER), strict=True)])
    every = ", ".join(
        f"transform(filter({k}, x -> {'length(' + _digits('x.v') + ') >= 9' if k in ('card', 'phone') else 'true'}), x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, 'v', x.v, 'before', lower(x.before), 'after', left(x.after, 1), 'ok', {CHECKS[i]}))"
        for i, k in enumerate(KINDS)
    )
    found = found.select("doc_id", "key", F.expr(f"concat({every})").alias("c"))
    return found.select("doc_id", "key", F.expr("filter(c, x -> x.ok)").alias("base"), F.expr("filter(c, x -> NOT x.ok AND NOT exists(filter(c, y -> y.ok), y -> y.s < x.e AND x.s < y.e))").alias("more"))


def voted(each: DataFrame) -> DataFrame:
    """A vote of each labeler on the candidate ``x``."""
    sign = lambda yes, no="false": f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"
    top = "array(" + ",".join(f"'{d}'" for d in TOP_DOMAINS) + ")"
    gazetteer = f"""CASE x.k WHEN 0 THEN {sign(f"array_contains({top}, lower(substring_index(x.v, '.', -1)))", "true")}
        WHEN 1 THEN {sign(f"NOT x.v RLIKE {quoted(RESERVED_NET)}", "true")}
        WHEN 2 THEN {sign(f"{_digits('x.v')} RLIKE {quoted(CARD_PREFIX)}", "true")}
        WHEN 3 THEN {sign(f"x.v RLIKE {quoted(CALLING)}", "true")} ELSE {OTHER_KNOWN} END"""
    return each.select(
        "*",
        F.expr(f"CASE WHEN x.ok THEN 1 WHEN x.k = 4 AND ({OTHER_HOLDS}) THEN 1 ELSE -1 END").alias("regex"),
        F.expr(gazetteer).alias("gazetteer"),
        F.expr(sign(f"x.before RLIKE {quoted(f'(^|[^a-z])({CUES})[^a-z]')}", f"x.before RLIKE {quoted(f'(^|[^a-z])({AGAINST})[^a-z]')}")).alias("context"),
        F.expr(sign("NOT (x.before RLIKE '[a-z0-9]$' OR x.after RLIKE '^[A-Za-z0-9]')", "true")).alias("boundary"),
    )


def reliabilities(patterns: list[tuple], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): the posterior of each pattern, and per kind the share
    of personal data and each labeler's chance of voting 1, 0, -1 given the truth."""
    posterior, told = {}, {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(v, n) for k, v, n in patterns if k == kind]
        total = sum(n for _, n in rows)
        post = {v: min(0.9, max(0.1, PRIOR + 0.4 * sum(v) / max(1, len(v)) + 0.2 * v[0])) for v, _ in rows}
        for _ in range(rounds):
            share = (sum(n * post[v] for v, n in rows) + 1) / (total + 2)
            rate = [[{vote: (sum(n * w(post[v]) for v, n in rows if v[j] == vote) + (2 if (vote > 0) == (truth > 0) and vote else 1)) for vote in (1, 0, -1)} for truth, w in ((1, lambda p: p), (0, lambda p: 1 - p))] for j in range(len(LABELERS))]
            rate = [[{v: c / sum(t.values()) for v, c in t.items()} for t in pair] for pair in rate]
            for v, _ in rows:
                yes = math.log(share) + sum(math.log(rate[j][0][x]) for j, x in enumerate(v))
                no = math.log(1 - share) + sum(math.log(rate[j][1][x]) for j, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(min(50, max(-50, no - yes))))
        told[kind] = (share, rate)
        posterior |= {(kind, v): p for v, p in post.items()}
    return posterior, told


#: Bounded features of a candidate, as SQL.
FEATURES = {
    "kind": "CAST(x.k AS STRING)",
    "length": "concat(x.k, ':', least(length(x.v), 40) div 3)",
    "digits": f"concat(x.k, ':', least(length({_digits('x.v')}), 20))",
    "form": f"concat(x.k, ':', CASE WHEN x.v RLIKE {quoted(COUNTRY)} THEN 'a' WHEN x.v RLIKE {quoted(SOCIAL)} THEN 's' ELSE 'n' END, ':', regex)",
    "separators": "concat(x.k, ':', least(length(regexp_replace(x.v, '[A-Za-z0-9]', '')), 8))",
    "votes": "concat_ws(':', x.k, regex, gazetteer, context, boundary)",
}


def _map(values: dict, otherwise: float, key: str) -> str:
    if not values:
        return f"CAST({otherwise!r} AS DOUBLE)"
    pairs = ", ".join(f"{quoted(k)}, {v!r}D" for k, v in sorted(values.items()))
    return f"coalesce(element_at(map({pairs}), {key}), {otherwise!r}D)"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other: one row per input row."""
    found = materialize(candidates(docs, id_col, text_col), "op9-candidates")
    votes = voted(found.filter("size(base) + size(more) > 0").select("doc_id", "key", F.explode(F.concat("base", "more")).alias("x")))
    counted = votes.groupBy(F.col("x.k").alias("k"), *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds x 3^labelers rows
    posterior, _ = reliabilities([(r.k, tuple(r[n] for n in LABELERS), r.n) for r in counted])
    soft = _map({":".join(map(str, (k, *v))): p for (k, v), p in posterior.items()}, PRIOR, FEATURES["votes"])
    features = F.expr("array(" + ", ".join(f"concat('{n}=', {e})" for n, e in FEATURES.items()) + ")")
    weighed = votes.select(F.expr(soft).alias("p"), F.explode(features).alias("f"))
    # feature values are bounded: kinds x (14 + 21 + 9 + 81 + 6) + kinds
    sums = {r.f: (r.yes, r.no) for r in weighed.groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    yes, no = (sum(s[i] for f, s in sums.items() if f.startswith("kind=")) + 1 for i in (0, 1))
    score = {f: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for f, (a, b) in sums.items()}
    logit = " + ".join([f"{math.log(yes / no)!r}D"] + [f"{1 / len(FEATURES)!r}D * {_map({f.split('=', 1)[1]: s for f, s in score.items() if f.startswith(n + '=')}, 0.0, e)}" for n, e in FEATURES.items()])
    added = (
        votes.filter("NOT x.ok")
        .withColumn("p", F.expr(f"1 / (1 + exp(-({logit})))"))
        .filter(F.col("p") >= threshold)
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.expr("named_struct('s', x.s, 'k', 4, 'e', x.e)")).alias("added"))
        .select(F.col("doc_id").alias("d"), F.col("key").alias("q"), "added")
    )
    rows = found.select("doc_id", "key", "base").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("q")), "left").withColumn("added", F.expr("coalesce(added, array())"))
    plain = "transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    return rows.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(base, x -> x.k = {k})) AS LONG)").alias(f"n_{KINDS[k]}") for k in range(4)],
        F.expr(f"sha2({listed('base', KINDS)}, 256)").alias("base_sha256"),
        F.expr(listed(f"concat({plain}, added)", KINDS)).alias("spans"),
        F.expr("CAST(size(added) AS LONG)").alias("n_other"),
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return detect(table(spark, sf_dir, "documents"))
