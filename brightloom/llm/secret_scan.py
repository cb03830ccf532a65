"""Secret scans by a random forest over candidate strings (operator 9), with DataFrame functions only.

Candidates of a whole text are, at each place the first that fits: what is assigned to a name like password, secret or
token (six characters or more); the password in an address (``scheme://user:password@host``); a signed web token with
its dots; any run of 16 or more of [A-Za-z0-9+/_-] with the padding after it. Each is described by its length, its
character classes, the likelihood of its character transitions, how much of it common words cover, whether it looks
like a path, and the words before and after it. A random forest trained on labelled findings removes false positives:
its trees are arrays of splits, constants of the plan that an expression walks, so that scanning is row by row inside the JVM:
nothing is shuffled, and a text with very many candidates takes O(n log n).

Findings are whole texts with one marked span each (text, start, end, secret). They are described by the same
expressions; the forest is fitted on the driver, on at most ``MOST_FINDINGS`` of them (a bounded sample, those with
the least hashes). Without findings of one's own, ``labelled_findings`` makes a set by rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from random import Random
from string import ascii_letters, ascii_uppercase, digits

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import least_hashes

CUT, TREES, DEPTH, SEED, FINDINGS, MOST_FINDINGS, CONTEXT, MASK = 0.5, 25, 6, 17, 6000, 50_000, 40, "<secret>"
_NAME = "passw(?:or)?d|passphrase|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
_ASSIGN = f"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{{0,30}}?(?i:{_NAME})[A-Za-z0-9_.-]{{0,20}}[\"']?\\s{{0,3}}(?::=|=>|[=:])\\s{{0,3}}(?:Bearer |Basic )?[\"'`]?"
_VALUE = "[^\\s\"'`<>,;]{5,}[^\\s\"'`<>,;.:()\\[\\]{}]"
_ADDRESS, _PASSWORD = "(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\\s:/@\"']{0,64}:", "[^\\s/@\"']{3,}(?=@)"
_SIGNED = "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}\\.[A-Za-z0-9_-]{5,}(?:\\.[A-Za-z0-9_-]*)?"
_RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
#: A candidate with what it is assigned to; the candidate ends where this does.
CANDIDATE = f"(?:{_ASSIGN}{_VALUE}|{_ADDRESS}{_PASSWORD}|{_SIGNED}|{_RUN})"
#: Common parts of identifiers and prose, for the coverage of a candidate: fixed values.
WORDS = (
    "about", "access", "account", "action", "address", "after", "array", "before", "build", "button", "cache", "client", "commit", "common",
    "config", "content", "control", "count", "create", "data", "default", "delete", "error", "event", "example", "file", "filter", "format",
    "function", "global", "group", "handler", "header", "image", "index", "input", "install", "item", "license", "list", "local", "manager",
    "message", "method", "model", "module", "name", "number", "object", "option", "output", "package", "page", "param", "path", "plugin",
    "process", "project", "public", "query", "request", "response", "result", "return", "server", "service", "session", "source", "start",
    "state", "static", "status", "string", "style", "system", "table", "template", "test", "text", "time", "type", "update", "user", "value",
    "version", "view", "width", "window", "with",
)
#: Parts of invented words of several languages.
SYLLABLES = ("sch", "er", "ung", "heit", "ge", "be", "ti", "on", "ment", "al", "ar", "en", "lich", "keit", "tra", "pre", "con", "ver", "lo", "na", "mi", "ro", "que", "eau", "th", "ing", "ly", "ness", "ci", "dad", "pf", "tz")
_CUE = "secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|client.?key|aws|signature"
_PLAIN = "commit|sha.?[0-9]*|md5|checksum|digest|hash|uuid|guid|isbn|issn|order|invoice|revision|integrity|etag|card|phone|page|figure"
_KINDS = 28

#: name -> SQL over a struct c (text, before, after, assigned). ``transitions`` is made of a table, see ``_told``.
FEATURES = {
    "length": "length(c.text)",
    "digits": "length(regexp_replace(c.text, '[^0-9]', '')) / length(c.text)",
    "upper": "length(regexp_replace(c.text, '[^A-Z]', '')) / length(c.text)",
    "lower": "length(regexp_replace(c.text, '[^a-z]', '')) / length(c.text)",
    "signs": "length(regexp_replace(c.text, '[A-Za-z0-9+/_-]', '')) / length(c.text)",
    "transitions": "",
    "kinds": "size(array_distinct(split(c.text, ''))) / length(c.text)",
    "hex": "cast(c.text rlike '^([0-9a-f]+|[0-9A-F]+)$' as double)",
    "words": f"1 - length(regexp_replace(lower(c.text), '{'|'.join(WORDS)}', '')) / length(c.text)",
    "path": "cast(c.text rlike '^/|/[a-z]{3,}/|//' or c.before rlike '[./~]$' or c.after rlike '^\\\\.[a-z]{1,4}\\\\b' as double)",
    "joined": "length(regexp_replace(c.text, '[^/_-]', '')) / length(c.text)",
    "form": "cast(c.text rlike '^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|sk_test_|rk_live_|sk-|AIza|eyJ|SG)' as double)",
    "uuid": "cast(c.text rlike '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$' as double)",
    "code": "cast(c.text rlike '[$({]|^[*xX.]+$|^[A-Za-z_]+(\\\\.[A-Za-z_]+)+$' as double)",
    "cue": f"cast(lower(c.before) rlike '({_CUE})[^a-z]*$' as double)",
    "cue_near": f"cast(lower(c.before) rlike '{_CUE}' as double)",
    "plain": f"cast(lower(c.before) rlike '({_PLAIN})[^a-z]*$' as double)",
    "set": "cast(c.before rlike '[=:]\\\\s*[\"\\']?$' as double)",
    "quoted": "cast(c.before rlike '[\"\\'`]$' and c.after rlike '^[\"\\'`]' as double)",
    "assigned": "c.assigned",
}


@dataclass(frozen=True)
class Forest:
    """Complete binary trees as arrays; node k has the children 2k+1 and 2k+2, the leaves follow the inner nodes."""

    transitions: tuple[float, ...]  # log odds of a pair of character kinds in secrets
    feature: tuple[int, ...]  # (trees * inner nodes)
    threshold: tuple[float, ...]
    share: tuple[float, ...]  # (trees * leaves) of secrets
    trees: int
    depth: int


def labelled_findings(spark: SparkSession, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """text, start, end, secret: ``n`` findings drawn by rule: keys, passwords and tokens of common forms in the places
    where they leak, against digests, identifiers, paths, numbers, references and words, also in such places."""
    draw = Random(seed)
    pick = draw.choice

    def some(letters: str, low: int, high: int | None = None) -> str:
        return "".join(draw.choices(letters, k=draw.randint(low, high or low)))

    def words(k: int, by: str = "") -> str:
        return by.join(draw.choices(WORDS, k=k))

    def spoken(low: int, high: int) -> str:
        return pick((str, str.title, str.upper))("".join(draw.choices(SYLLABLES, k=draw.randint(low, high))))

    hexes, alnum = "0123456789abcdef", ascii_letters + digits
    placed = (  # secrets that only stand where secrets are set
        lambda: some(hexes, int(pick(("32", "40", "48", "64")))), lambda: some(alnum + "+/", 24, 88), lambda: some(alnum, 20, 64),
        lambda: some(alnum, 8, 18) + pick(digits), lambda: words(1) + str(draw.randint(1, 9999)) + pick("!#@$_") + some(alnum, 2, 5), lambda: words(1).title() + some(digits, 2, 4) + pick("!#$%") + some(alnum, 0, 4))
    formed = (  # secrets by their form, wherever they stand
        lambda: pick(("AKIA", "ASIA")) + some(ascii_uppercase + digits, 16), lambda: "eyJ" + some(alnum, 17, 40) + ".eyJ" + some(alnum, 20, 60) + "." + some(alnum + "_-", 22, 43),
        lambda: pick(("ghp_", "gho_", "sk_live_", "sk_test_", "sk-", "glpat-", "AIza", "xoxb-")) + some(alnum, 24, 40))
    leaks = ("token = \"", "api_key: ", "secret=", "password = '", "Authorization: Bearer ", "AWS_SECRET_ACCESS_KEY=", "client_secret\": \"", "auth_token='", "private_key: ", "credentials = ", "API-KEY=",
             "DB_PASSWORD=", "passwd: ", "my_service_auth_token: ", "GITHUB_ACCESS_TOKEN=", "pwd=", "secretKey := \"")
    address = ("postgres://admin:", "mysql://root:", "https://deploy:", "amqp://guest:", "redis://:")
    plain = (
        lambda: some(hexes, int(pick(("32", "40", "64")))), lambda: words(4, "_"), lambda: "/" + words(4, "/"), lambda: "".join(w.title() for w in draw.choices(WORDS, k=4)), lambda: some(digits, 16, 19),
        lambda: pick(("0", "-", "_", "a", "_-", "*", "x")) * draw.randint(16, 60), lambda: words(5, "-"), lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: words(5), lambda: pick(("0", "9", "12", "7")) * 16,
        lambda: spoken(6, 8), lambda: spoken(8, 10), lambda: spoken(5, 12))
    named = (  # what stands beside names of secrets without being one
        lambda: words(1) + "." + words(2, "_"), lambda: "${" + words(2, "_").upper() + "}", lambda: words(1) + pick(("ment", "ing", "ed", "s", "able", "ness")), lambda: "get" + words(1).title() + "(" + words(1) + ")",
        lambda: pick("*x.X") * draw.randint(6, 12), lambda: words(2, "-"), lambda: "process.env." + words(1).upper(), lambda: spoken(3, 5), lambda: spoken(3, 5).lower())
    calm = ("commit ", "sha256: ", "checksum = ", "see ", "in the file ", "md5 ", "order ", "the ", "of ", "invoice no. ", "import ", "revision ", "class ", "is ", "called ", "integrity=\"sha512-", "etag: \"", "")
    said = ("the secret: ", "password: ", "token is: ", "auth = ", "token=", "secret = ", "password must be: ", "\"password\": \"")
    rows = []
    for k in range(n):
        secret, after = k % 2 == 1, pick(("\"", " ", "'", ";", " and", ", of", ""))
        if secret and draw.random() < 0.3:
            value, place = pick(formed)(), pick(calm if draw.random() < 0.5 else leaks)
        elif secret and draw.random() < 0.15:
            value, place, after = pick(placed[3:])(), pick(address), "@db.example.org"
        elif secret:
            value, place = pick(placed)(), pick(leaks)
        elif draw.random() < 0.3:
            value, place = pick(named)(), pick(said)
        else:  # plain strings also stand where secrets do, unless only the place tells them apart
            kind = draw.randrange(len(plain))
            value, place = plain[kind](), pick(leaks if draw.random() < 0.125 and kind not in (0, 7) else calm)
        before = pick(("and ", "the that in ", "", "said: ", "] ")) + place
        rows.append((before + value + after, len(before), len(before) + len(value), secret))
    return spark.createDataFrame(rows, "text string, start long, end long, secret boolean")


def _constant(numbers, kind: str) -> str:
    """An array as one constant of a plan."""
    return f"cast(split('{','.join(repr(x) for x in numbers)}', ',') as array<{kind}>)"


def _told(transitions: tuple[float, ...]) -> str:
    """SQL of the array of the features of a struct c."""
    kind = f"case when x between 'a' and 'z' then ascii(x) - 97 when x between '0' and '9' then {_KINDS - 2} else {_KINDS - 1} end"
    odds = (f"transform(array(transform(split(lower(c.text), ''), x -> {kind})), s -> aggregate(zip_with(s, slice(s, 2, size(s)), "
            f"(a, b) -> get({_constant(transitions, 'double')}, a * {_KINDS} + b)), 0D, (t, x) -> t + coalesce(x, 0D)) / size(s))[0]")
    return "array(" + ", ".join(f"coalesce(cast({odds if name == 'transitions' else sql} as double), 0D)" for name, sql in FEATURES.items()) + ")"


def _votes(forest: Forest, row: str) -> str:
    """SQL of the trees' mean share for a secret, over an array of features."""
    inner, leaves = 2**forest.depth - 1, 2**forest.depth
    at = f"t * {inner} + k"
    node = f"aggregate(sequence(1, {forest.depth}), 0, (k, d) -> 2 * k + if(get({row}, get({_constant(forest.feature, 'int')}, {at})) <= get({_constant(forest.threshold, 'double')}, {at}), 1, 2))"
    return f"aggregate(sequence(0, {forest.trees - 1}), 0D, (v, t) -> v + get({_constant(forest.share, 'double')}, t * {leaves} + {node} - {inner})) / {forest.trees}"


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, least: int = 3) -> tuple[list[int], list[float], list[float]]:
    """Features, thresholds and leaves' shares of trees on bootstrap samples, each split the best by Gini of a random choice of features."""
    rng = np.random.default_rng(seed)
    inner, tried = 2**depth - 1, int(np.ceil(np.sqrt(x.shape[1])))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[:-1])) for j in range(x.shape[1])]
    feature, threshold, share = [], [], []
    for _ in range(trees):
        rows = {0: rng.integers(0, len(x), len(x))}
        own_feature, own_threshold, own_share = [0] * inner, [float("inf")] * inner, [0.0] * (inner + 1)
        for k in range(inner):
            at = rows.pop(k)
            best = (1e-9, 0, float("inf"))
            for j in rng.permutation(x.shape[1])[:tried].tolist() if 0 < y[at].sum() < len(at) else []:
                left = x[at, j][:, None] <= cuts[j][None, :]
                n, hits = left.sum(axis=0), (left * y[at][:, None]).sum(axis=0)
                m, more = len(at) - n, y[at].sum() - hits
                ok = (n >= least) & (m >= least)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, hits**2 / n + more**2 / m + (n - hits) ** 2 / n + (m - more) ** 2 / m, 0.0)
                gain -= (y[at].sum() ** 2 + (len(at) - y[at].sum()) ** 2) / len(at)
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (float(gain[c]), j, float(cuts[j][c]))
            own_feature[k], own_threshold[k] = best[1], best[2]
            go = x[at, best[1]] <= best[2]
            for child, part in ((2 * k + 1, at[go]), (2 * k + 2, at[~go])):
                if child < inner:
                    rows[child] = part
                else:
                    own_share[child - inner] = float(y[part].mean()) if len(part) else 0.0
        feature += own_feature
        threshold += [t if np.isfinite(t) else 1e308 for t in own_threshold]
        share += [round(s, 6) for s in own_share]
    return feature, threshold, share


def _kinds(text: str) -> list[int]:
    return [ord(c) - 97 if "a" <= c <= "z" else _KINDS - 2 if "0" <= c <= "9" else _KINDS - 1 for c in text.lower()]


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, most: int = MOST_FINDINGS) -> Forest:
    """A forest over the candidates of labelled findings (text, start, end, secret); a candidate is a secret if it
    overlaps the span of a finding that is one. At most ``most`` findings are learnt from, those with the least hashes."""
    rows = findings.selectExpr("text", "cast(start as long) as start", "cast(`end` as long) as `end`", "coalesce(cast(secret as boolean), false) as secret")
    spark = findings.sparkSession
    drawn = spark.createDataFrame(sorted(map(tuple, least_hashes(rows, F.col("text"), most, rows.count(), seed).collect()), key=str), rows.schema)
    hit = "c.text, c.before, c.after, c.assigned, secret and c.start < `end` and c.`end` > start as secret"
    found = _candidates(drawn).selectExpr("start", "`end`", "secret", "explode(secret_described_) as c").selectExpr(*hit.split(", "))
    seen = sorted(map(tuple, found.collect()))
    described = spark.createDataFrame(seen, found.schema).selectExpr("struct(text, before, after, assigned) as c", "secret")
    pairs = np.ones((2, _KINDS * _KINDS))
    for text, _, _, _, secret in seen:
        own = _kinds(text)
        np.add.at(pairs[int(secret)], [a * _KINDS + b for a, b in zip(own, own[1:], strict=False)], 1)
    pairs /= pairs.sum(axis=1, keepdims=True)
    transitions = tuple(round(float(v), 4) for v in np.log(pairs[1] / pairs[0]))
    told = sorted(tuple(r["f"]) + (float(r["secret"]),) for r in described.selectExpr(f"{_told(transitions)} as f", "secret").collect())
    table = np.array(told).reshape(-1, len(FEATURES) + 1)
    feature, threshold, share = grow(table[:, :-1], table[:, -1], trees, depth, seed)
    return Forest(transitions, tuple(feature), tuple(threshold), tuple(share), trees, depth)


@cache
def _default_forest(spark: SparkSession) -> Forest:
    return train(labelled_findings(spark))


def _running(lengths: str) -> str:
    """SQL of the running sums of an array, by doubling up to the longest array there is."""
    out = lengths
    for k in range(31):
        step = 1 << k
        out = f"transform(array({out}), s -> case when size(s) > {step} then transform(s, (v, i) -> if(i >= {step}, v + get(s, i - {step}), v)) else s end)[0]"
    return out


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secret_parts_`` (what stands between the candidates, names that they are assigned to included)
    and ``secret_described_`` (array of start, end, text, before, after, assigned; code points, end exclusive)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("secret_texts_", F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)))
    rows = rows.withColumn("secret_parts_", F.when(F.size("secret_texts_") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))
    assigned, address = (f"nullif(regexp_extract(m, {_sql(p)}, 1), '')" for p in (f"^{_ASSIGN}({_VALUE})$", f"^{_ADDRESS}([^\\s/@\"']{{3,}})$"))
    # a name and its value part here
    rows = rows.withColumn("secret_values_", F.expr(f"transform(secret_texts_, m -> coalesce({assigned}, {address}, m))"))
    names = "zip_with(secret_texts_, secret_values_, (m, v) -> left(m, length(m) - length(v)))"
    rows = rows.withColumn("secret_parts_", F.expr(f"zip_with(secret_parts_, {names}, (p, n) -> concat(p, coalesce(n, '')))"))
    rows = rows.withColumn("secret_ends_", F.expr(_running("zip_with(secret_values_, slice(secret_parts_, 1, size(secret_values_)), (m, p) -> cast(length(m) + length(p) as bigint))")))
    # the characters around a candidate in the whole text: five candidates with their names hold 40 at least
    before = ", ".join(f"get(secret_values_, i - {k}), get(secret_parts_, i - {k - 1})" for k in (6, 5, 4, 3, 2, 1))
    after = ", ".join(f"get(secret_parts_, i + {k}), get(secret_values_, i + {k})" for k in (1, 2, 3, 4, 5, 6))
    described = (
        "transform(secret_values_, (t, i) -> named_struct('start', secret_ends_[i] - length(t), 'end', secret_ends_[i], 'text', t, "
        f"'before', right(concat_ws('', {before}), {CONTEXT}), 'after', left(concat_ws('', {after}), {CONTEXT}), 'assigned', if(length(t) < length(secret_texts_[i]), 1D, 0D)))"
    )
    return rows.withColumn("secret_described_", F.expr(described)).drop("secret_texts_", "secret_values_", "secret_ends_")


def found_in(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """``docs`` with two more columns: ``secret_parts_`` (what stands between the candidates) and ``secret_found_`` (array
    of start, end, text, score; code points, end exclusive; one for each candidate)."""
    forest = forest or _default_forest(docs.sparkSession)
    rows = _candidates(docs).withColumn("secret_rows_", F.expr(f"transform(secret_described_, c -> {_told(forest.transitions)})"))
    scored = f"zip_with(secret_described_, secret_rows_, (c, f) -> named_struct('start', c.start, 'end', c.`end`, 'text', c.text, 'score', {_votes(forest, 'f')}))"
    return rows.withColumn("secret_found_", F.expr(scored)).drop("secret_described_", "secret_rows_")


def _secrets(cut: float) -> Column:
    return F.filter("secret_found_", lambda s: s["score"] >= cut)


def scan(docs: DataFrame, forest: Forest | None = None, cut: float = CUT) -> DataFrame:
    """doc_id, n_candidates, n_secrets and secrets (array of start, end, text, score) of every row.

    ``docs`` has doc_id and text, other columns are ignored. A null or empty text has no candidates. Repeated rows stay
    repeated, doc_id may be null, an empty table gives an empty result."""
    rows = found_in(docs.select("doc_id", "text"), forest)
    return rows.select("doc_id", F.size("secret_found_").cast("long").alias("n_candidates"), F.size(_secrets(cut)).cast("long").alias("n_secrets"), _secrets(cut).alias("secrets"))


def redact(docs: DataFrame, forest: Forest | None = None, cut: float = CUT, mask: str = MASK) -> DataFrame:
    """Every row of ``docs`` with its secrets replaced by ``mask`` and n_chars, where there is such a column, counted anew.

    Null and empty texts stay as they are, and so do texts without secrets. Repeated rows stay repeated, doc_id may be
    null or lack, an empty table gives an empty result; other columns pass whatever their names."""
    rows = found_in(docs, forest)
    shown = F.transform("secret_found_", lambda s: F.when(s["score"] >= cut, F.lit(mask)).otherwise(s["text"]))
    text = F.array_join(F.zip_with("secret_parts_", F.concat(shown, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    some = F.size(_secrets(cut)) > 0
    rows = rows.withColumn("text", F.when(some, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def told(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets and the secrets' spans as text (start:end, comma-joined)."""
    return scan(docs).select("doc_id", "n_candidates", "n_secrets", F.concat_ws(",", F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("spans"))
