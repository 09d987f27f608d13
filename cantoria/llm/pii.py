"""Personal data by weak supervision, with built-in functions only.

1. ``candidates``: regular expressions cut every whole text into hits and the pieces between them; running sums of
   their lengths give code-point offsets, all in the document's row. Emails, addresses of the internet protocol,
   payment cards and phone numbers that pass their checks are *base* spans; secrets (after a key word, of a known form, blocks
   of private keys, or long runs of mixed letters and digits), phone numbers without a country code, national numbers and
   account numbers (IBAN, check digits tested) are candidates that the method may add.
2. Four labelers vote on every candidate (1 personal, 0 not, -1 no opinion): strict format, gazetteers of cue words per
   language, characters around it, variety of its characters.
3. ``fit``: candidates are counted per (votes, features); these tables are bounded by the vocabulary of votes and
   features, not by the corpus. Expectation-maximisation (a naive Bayes model with one prior per kind) estimates the
   labelers' reliabilities; its probabilities are the targets of a logistic span classifier on the features.
4. ``spans``: base spans stay; other candidates stay if the classifier gives at least ``threshold``.

Cost: one pass over the texts; the candidates are written once per document and scored in that row, so no key is
shuffled but the bounded counts. Patterns are possessive and anchored to run starts, so a text without spaces costs
linear time; offsets are summed in two levels, so a text with very many hits stays near linear.

Defined results: null text counts as empty (no spans, hash of the empty string); a table without candidates trains
nothing and returns base spans only; repeated rows and ids are judged row by row; the id may be null; other columns
of the input are not carried (join on the id); candidates that overlap a base span are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantoria.llm.common import staged

BASE_KINDS = ["email", "ip", "card", "phone"]
EXTRA_KINDS = ["secret", "local_phone", "national_id", "iban"]
KINDS = BASE_KINDS + EXTRA_KINDS

_LOCAL = "A-Za-z0-9._%+-"
#: words before a secret value
SECRET_WORDS = ["password", "passwd", "pwd", "token", "secret", "api[_-]?key", "passwort", "schlüssel", "mot de passe", "jeton", "contraseña", "clave"]
#: leftmost matches of the stated patterns; lookbehind or \G (end of the last match) only skip starts that cannot match
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "extra": (r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
              rf"|(?iu:{'|'.join(SECRET_WORDS)})\x20?[=:]\x20?\"?[0-9A-Za-z_+/-]{{12,}}+={{0,2}}\"?"
              r"|-----BEGIN (?:[A-Z]++\x20){0,3}?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END (?:[A-Z]++\x20){0,3}?PRIVATE KEY-----"
              r"|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}+|(?:\x20[0-9A-Z]{4}){2,7}+(?:\x20[0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
              r"|(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{32,}+"
              r"|\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20-][0-9]{4}(?![0-9])"
              r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: beginnings of words that speak for personal data, and of words that speak against it, per language
CUES = {
    "en": ["mail", "e-mail", "email", "contact", "write to", "call", "phone", "telephone", "mobile", "fax", "ip", "host", "server", "card", "visa",
           "passw", "token", "secret", "key", "akia", "ssn", "account", "private key", "bearer"],
    "de": ["kontakt", "anruf", "telefon", "handy", "karte", "passwort", "schlüssel", "konto", "schreib"],
    "fr": ["courriel", "contactez", "appelez", "téléphone", "portable", "carte", "mot de passe", "jeton", "clé", "compte"],
    "es": ["correo", "contacto", "llama", "teléfono", "móvil", "tarjeta", "contraseña", "clave", "cuenta"],
}
ANTI_CUES = {
    "en": ["version", "license", "licence", "isbn", "section", "chapter", "page", "figure", "equation", "release", "checksum", "commit", "digest", "sha", "md5", "uuid"],
    "de": ["fassung", "lizenz", "abschnitt", "kapitel", "seite", "abbildung", "gleichung", "prüfsumme"],
    "fr": ["licence", "chapitre", "équation", "somme de contrôle"],
    "es": ["versión", "licencia", "sección", "capítulo", "página", "figura", "ecuación"],
}


def begins(words: dict[str, list[str]]) -> str:
    """A pattern that finds any of the words of all languages at the beginning of a word."""
    return r"(?<!\p{L})(?:" + "|".join(sorted({w for own in words.values() for w in own})) + ")"


OPENING = r"(^|[\s\"'(\[<:=,;])$"
CLOSING = r"^($|[\s\"')\]>.,;:!?])"
BLOCK = 64
LABELERS = ["strict", "gazetteer", "context", "variety"]
FEATURES = ["left", "right", "size", "digits"]
EM_ROUNDS = 50
THRESHOLD = 0.5


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once (as a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _hits(t: Column, pattern: str) -> Column:
    """array<struct<start, end, text, left, right>>: all matches with code-point offsets and some text around them."""
    def located(hits, pieces, lens, blocks):
        at = lambda i: (F.element_at(blocks, (F.floor(i / BLOCK) + 1).cast("int"))
                        + _total(F.slice(lens, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK + 1)))
        return F.transform(hits, lambda m, i: F.struct(
            (at(i) - F.length(m)).alias("start"), at(i).alias("end"), m.alias("text"),
            F.right(F.get(pieces, i), F.lit(32)).alias("left"), F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(8)).alias("right")))

    def offsets(hits, pieces, lens):
        n = F.ceil(F.size(lens) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n), lambda k: _total(F.slice(lens, k * BLOCK + 1, BLOCK)))
        lower = lambda s: F.transform(s, lambda _, k: _total(F.slice(s, 1, k)))
        return bind(sums, lambda s: bind(lower(s), lambda blocks: located(hits, pieces, lens, blocks)))

    return bind(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda hits: bind(
        F.split(t, pattern, -1), lambda pieces: bind(
            F.transform(hits, lambda m, i: F.length(m) + F.length(F.get(pieces, i))),
            lambda lens: offsets(hits, pieces, lens))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _extra_kind(m: Column) -> Column:
    return (F.when(m.rlike(r"^\("), "local_phone").when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national_id")
            .when(m.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Z\x20]{11,38}$") & _account(m), "iban").otherwise("secret"))


def _account(m: Column) -> Column:
    """Whether an account number's remainder by 97 is 1 (country and check digits moved to the end, A = 10 to Z = 35)."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    rest = F.aggregate(moved, F.lit(0), lambda r, c: F.when(c == "", r).when(F.ascii(c) < 58, (r * 10 + F.ascii(c) - 48) % 97)
                       .otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _proposed(m: Column) -> Column:
    """Whether a match of the extra patterns is a candidate: what only looks like an account number is none."""
    return ~m.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Z\x20]*$") | _account(m) | m.rlike(r"^[0-9A-Za-z]{32,}$")


def _judged(kind: Column, h: Column) -> Column:
    """A hit with its kind, votes and features."""
    m = h["text"]
    digits = F.length(_digits(m))
    strict = (F.when(kind == "email", m.rlike(r"\.[A-Za-z]{2,24}$")).when(kind == "ip", ~m.rlike(r"^(0|127|255)\."))
              .when(kind == "card", m.rlike(r"^[3-6]")).when(kind == "phone", m.rlike(r"^\+[1-9]") & (digits >= 10))
              .when(kind == "secret", m.rlike(r"AKIA|[0-9A-Za-z]{16}") & (digits >= 2)).when(kind == "iban", F.lit(True)).otherwise(digits >= 9))
    near = F.lower(F.concat(h["left"], m))
    gazetteer = F.when(near.rlike(begins(ANTI_CUES)), 0).when(near.rlike(begins(CUES)), 1).otherwise(-1)
    context = (h["left"].rlike(OPENING) & h["right"].rlike(CLOSING)).cast("int")
    variety = (F.size(F.array_distinct(F.split(F.substring(m, 1, 200), ""))) >= 5).cast("int")
    side = lambda c: (F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9]"), "digit")
                      .when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[\"'()\\[\\]<>]"), "bracket").otherwise("mark"))
    size = F.when(F.length(m) < 10, "short").when(F.length(m) < 20, "middle").otherwise("long")
    return F.struct(kind.alias("kind"), h["start"].alias("start"), h["end"].alias("end"), F.coalesce(strict, F.lit(False)).cast("int").alias("strict"),
                    gazetteer.alias("gazetteer"), context.alias("context"), variety.alias("variety"),
                    side(F.right(h["left"], F.lit(1))).alias("left"), side(F.left(h["right"], F.lit(1))).alias("right"), size.alias("size"),
                    F.when(digits * 2 >= F.length(m), "many").when(digits > 0, "some").otherwise("none").alias("digits"))


SPAN = ("array<struct<kind:string,start:int,end:int,strict:int,gazetteer:int,context:int,variety:int,"
        "left:string,right:string,size:string,digits:string>>")


def _base_spans(t: Column, kind: str) -> Column:
    valid = F.filter(_hits(t, PATTERNS[kind]), lambda h: F.coalesce(_valid(kind, h["text"]), F.lit(False)))
    return F.transform(valid, lambda h: _judged(F.lit(kind), h))


def _of_kind(spans_: str, kind: str) -> Column:
    return F.filter(spans_, lambda s: s["kind"] == kind)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base (array of valid base spans by kind and start), extra (array of other candidates)."""
    t = F.coalesce(F.col(text), F.lit(""))
    #: what a text must hold for a pattern to match: a cheap test before the patterns
    digit = t.rlike("[0-9]")
    may = {"email": t.contains("@") & t.contains("."), "ip": digit & t.contains("."), "card": digit, "phone": t.contains("+") & digit,
           "extra": t.rlike(r"[=:0-9]|-----BEGIN|AKIA")}
    found = {}
    for kind in BASE_KINDS:
        found[f"_{kind}"] = F.coalesce(F.when(may[kind], _base_spans(t, kind).cast(SPAN)), F.array().cast(SPAN))
    proposed = F.filter(_hits(t, PATTERNS["extra"]), lambda h: _proposed(h["text"]))
    extra = F.transform(proposed, lambda h: _judged(_extra_kind(h["text"]), h)).cast(SPAN)
    found["_extra"] = F.coalesce(F.when(may["extra"], extra), F.array().cast(SPAN))
    rows = docs.select(F.col(key), *[v.alias(k) for k, v in found.items()])
    rows = rows.select(key, F.concat(*[F.col(f"_{k}") for k in BASE_KINDS]).alias("base"), "_extra")
    apart = F.filter("_extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return rows.select(key, "base", apart.alias("extra"))


def em(patterns: list[dict]) -> tuple[dict, list[float]]:
    """Reliabilities of the labelers and the probability of each pattern.

    patterns: dicts with kind, the votes and n. Model: y ~ Bernoulli(prior of the kind), votes independent given y.
    Starts from the share of positive votes; add-one smoothing keeps every probability inside (0, 1)."""
    p = []
    for x in patterns:
        votes = [x[v] for v in LABELERS if x[v] >= 0]
        p.append((sum(votes) + 0.5) / (len(votes) + 1))
    theta: dict = {}
    for _ in range(EM_ROUNDS):
        prior = {}
        for kind in {x["kind"] for x in patterns}:
            own = [(q, x["n"]) for q, x in zip(p, patterns) if x["kind"] == kind]
            prior[kind] = (sum(q * n for q, n in own) + 1) / (sum(n for _, n in own) + 2)
        theta = {}
        for name in LABELERS:
            for y in (0, 1):
                mass = [(q if y else 1 - q) * x["n"] for q, x in zip(p, patterns)]
                for vote in (-1, 0, 1):
                    theta[name, y, vote] = (sum(m for m, x in zip(mass, patterns) if x[name] == vote) + 1) / (sum(mass) + 3)
        p = []
        for x in patterns:
            odds = math.log(prior[x["kind"]]) - math.log(1 - prior[x["kind"]])
            odds += sum(math.log(theta[v, 1, x[v]]) - math.log(theta[v, 0, x[v]]) for v in LABELERS)
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return theta, p


def logistic(rows: list[tuple[list[str], float, float]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model on indicator features; rows: (features, target probability, count)."""
    weights: dict[str, float] = {}
    scale = sum(n for _, _, n in rows) or 1.0
    speed: dict[str, float] = {}
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for names, target, n in rows:
            z = sum(weights.get(f, 0.0) for f in names)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * n / scale
            for f in names:
                grad[f] = grad.get(f, 0.0) + miss
        for f, g in grad.items():
            g += ridge * weights.get(f, 0.0)
            speed[f] = speed.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) - rate * g / (math.sqrt(speed[f]) + 1e-9)
    return weights


def fit(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from the counted votes and features of all candidates.

    At most 3^4 vote patterns x 8 kinds x the combinations of FEATURES come to the driver, whatever the corpus."""
    rows = (found.select(F.explode(F.concat("base", "extra")).alias("s")).groupBy(*[F.col(f"s.{c}").alias(c) for c in ["kind", *LABELERS, *FEATURES]])
            .agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *LABELERS, *FEATURES).collect())
    if not rows:
        return {}
    patterns: dict = {}
    for r in rows:
        k = (r["kind"], *[r[v] for v in LABELERS])
        patterns[k] = patterns.get(k, 0) + r["n"]
    table = [dict(zip(["kind", *LABELERS], k), n=n) for k, n in patterns.items()]
    _, p = em(table)
    truth = dict(zip(patterns, p))
    return logistic([(_names(r), truth[(r["kind"], *[r[v] for v in LABELERS])], float(r["n"])) for r in rows])


def _names(r) -> list[str]:
    return ["bias", f"kind={r['kind']}", *[f"{f}={r[f]}" for f in FEATURES]]


def _probability(s: Column, weights: dict[str, float]) -> Column:
    z = F.lit(float(weights.get("bias", 0.0)))
    for f in ["kind", *FEATURES]:
        own = {k.split("=", 1)[1]: w for k, w in weights.items() if k.startswith(f"{f}=")}
        if own:
            z = z + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(own.items()) for x in kv]), s[f]), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, base, added: arrays of struct(kind, start, end), by kind as listed in KINDS, then start."""
    found = staged(candidates(docs, key, text), "pii")
    weights = fit(found)
    narrow = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    kept = F.filter("extra", lambda s: _probability(s, weights) >= threshold) if weights else F.col("extra")
    in_order = F.concat(*[_of_kind("kept", k) for k in EXTRA_KINDS])
    return found.withColumn("kept", kept).select(key, narrow(F.col("base")).alias("base"), narrow(in_order).alias("added"))


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (base and added)."""
    counts = [F.size(_of_kind("base", k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(key, *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
                        (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"))
