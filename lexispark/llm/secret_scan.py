"""Secret scan: patterns propose candidates, a random forest removes false positives.

The forest reads a candidate's length, its character transitions, how far a
dictionary covers it, the path it stands in and the words around it.  The
dictionary is the corpus' own: the words that most of its documents hold, with a
few dozen of configuration files.  The forest is trained from labelled findings
(``labelled`` reads them from a table, a bounded sample of them); where none are
given, from examples made by ``example_findings`` (generated credentials against
generated identifiers, digests, numbers, paths, placeholders and plain words in
their usual places).

A scan happens within a row: no shuffle, and what is broadcast is one forest and
one dictionary of bounded size.  Patterns and features take time in proportion
to a text's length.

Defined results: a null text has no findings and stays null, an empty text
stays empty; overlapping candidates count once, the earlier and longer first;
repeated rows each get the same answer; an empty table gives an empty result;
other columns, whatever their names, play no part (a path column is optional).
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, fresh, give_back

# Public credential formats, and the words that announce or deny a secret.
FORMATS = {
    "cloud_key_id": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*(?:-(?!----)[^-]*)*-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "web_token": r"(?<![\w-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
    "prefixed": r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|npm_|hf_|SG\.)[\w.-]{16,}",
    "in_url": r"(?<=://)[^\s:/@]+:[^\s:/@]{4,}(?=@)",
    "assigned": r"""(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|credentials?|(?:api|access|auth|secret|private|signing|encryption|session|client|master)[_-]?key)(?:[_-]?(?:key|value|text|string))?["']?\s{0,3}(?:=>|:=|=|:)\s{0,3}["']?(?P<value>[^\s"',;]{6,})""",
    "random": r"(?<![\w+/=-])[A-Za-z0-9+/=_-]{20,}(?![\w+/=-])",
}
ANNOUNCING = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private")
DENYING = ("example", "sample", "dummy", "test", "placeholder", "changeme", "your", "xxxx", "sha", "md5", "commit", "checksum", "digest", "uuid", "revision", "hash", "isbn", "lock")
WORDS = ("the", "and", "for", "with", "that", "this", "from", "have", "user", "name", "file", "path", "data", "value", "string", "number", "service", "server", "client", "config", "default", "example", "password", "secret", "token", "change", "your", "here", "test", "sample", "local", "host", "main", "index", "list", "item", "page", "event", "handler", "model", "table", "order", "time", "date", "code", "base", "type", "class", "null", "none", "true", "false", "enter", "required", "must", "tion", "ing", "ment")
REPLACEMENT = "[SECRET]"
FEATURES = ("length", "entropy", "upper", "lower", "digit", "mark", "changes", "unlikely", "runs", "coverage", "hex", "distinct", "announced", "denied_before", "denied_inside", "path_of_code", "path_of_tests", "format")
#: Holds wherever a pattern can match: texts without it are done.
HINT = re.compile(r"[A-Za-z0-9+/=_-]{20}|[sS][wW][oO]?[rR]?[dD]|[pP][wW][dD]|[eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[kK][eE][yY]|[eE][nN][tT][iI][aA][lL]|://|eyJ|-----BEGIN|xox[abprs]-|SG\.|AIza|hf_|npm_|k-|k_live|gh[pousr]_|glpat")
FINDER = re.compile("|".join(f"(?P<{k}>{p.replace('(?i)', '')})" if k != "assigned" else f"(?P<{k}>(?i:{p.replace('(?i)', '')}))" for k, p in FORMATS.items() if k != "random"))
RANDOM = re.compile(FORMATS["random"])
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def mixed_runs(text: str) -> Iterator[re.Match]:
    """Matches of the random format: those of its runs that hold letters and digits, wherever in them."""
    for m in RANDOM.finditer(text):
        if LETTER.search(text, m.start(), m.end()) and DIGIT.search(text, m.start(), m.end()):
            yield m


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    value: str
    before: str
    path: str = ""


def candidates(text: str, path: str = "") -> list[Candidate]:
    """What the patterns propose, in order, without overlaps; reach: the whole text."""
    out = []
    if not HINT.search(text):
        return out
    runs, named = mixed_runs(text), FINDER.search(text)
    run = next(runs, None)
    while named or run:
        # The earlier of both; of two that begin together, the named format.
        m = named if named and (not run or named.start() <= run.start()) else run
        out.append(_candidate(text, "random" if m is run else m.lastgroup if m.lastgroup != "value" else "assigned", m, path))
        if named and named.start() < m.end():
            named = FINDER.search(text, m.end())
        while run and run.start() < m.end():
            run = next(runs, None)
    return out


def _candidate(text: str, kind: str, m: re.Match, path: str) -> Candidate:
    start, end = m.span("value") if kind == "assigned" else m.span()
    return Candidate(kind, start, end, text[start:end], text[max(0, start - 40) : start], path)


@dataclass(frozen=True)
class Dictionary:
    """Known words, and the log odds of one letter after another in them."""

    words: frozenset[str]
    transitions: np.ndarray
    longest: int

    def covered(self, low: str) -> float:
        """The share of a lower-case string that stands in known words, the longest first from its start on."""
        at = total = 0
        while at < len(low):
            size = next((n for n in range(min(self.longest, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            total += size
            at += size or 1
        return total / max(1, len(low))


def dictionary(more: Iterable[str] = ()) -> Dictionary:
    words = frozenset((*WORDS, *(w for w in more if len(w) > 2)))
    seen = np.ones((27, 27))
    for w in sorted(words):
        k = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in w]
        np.add.at(seen, (k[:-1], k[1:]), 4)
    return Dictionary(words, np.log(seen / seen.sum(axis=1, keepdims=True)), max(map(len, words)))


@lru_cache(maxsize=1)
def plain_dictionary() -> Dictionary:
    return dictionary()


def frequent_words(docs: DataFrame, *, text: str = "text", most: int = 5000, least_documents: int = 3) -> list[str]:
    """The words of 4 to 14 letters a-z that most documents hold, counted over all of docs; at most ``most``, ties by name."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![a-z0-9])([a-z]{4,14})(?![a-z0-9])"), 1))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents)
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def vector(c: Candidate, known: Dictionary | None = None) -> list[float]:
    known = known or plain_dictionary()
    v, n = c.value, max(1, len(c.value))
    low, before = v.lower(), c.before.lower()
    counts = np.array([v.count(x) for x in set(v)], float) / n
    classes = [3 if x.isdigit() else 2 if x.isupper() else 1 if x.isalpha() else 0 for x in v]
    places = [min(max(ord(x) - 96, 0), 26) if "a" <= x <= "z" else 0 for x in low]
    table = known.transitions
    return [
        min(n, 200),
        float(-(counts * np.log2(counts)).sum()),
        sum(x == 2 for x in classes) / n,
        sum(x == 1 for x in classes) / n,
        sum(x == 3 for x in classes) / n,
        sum(x == 0 for x in classes) / n,
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        float(np.mean([-table[a, b] for a, b in zip(places, places[1:])] or [0])),
        max((len(m[0]) for m in re.finditer(r"(.)\1*", v, re.S)), default=0) / n,
        known.covered(low),
        float(all(x in string.hexdigits for x in v)),
        len(set(v)) / n,
        float(any(w in before[-24:] for w in ANNOUNCING)),
        float(any(w in before for w in DENYING)),
        float(any(w in low for w in DENYING)),
        float(c.path.endswith((".py", ".js", ".java", ".go", ".rb", ".env", ".yml", ".yaml", ".json", ".toml"))),
        float(any(w in c.path.lower() for w in ("test", "spec", "example", "fixture", "mock", "lock"))),
        float(list(FORMATS).index(c.kind)),
    ]


def example_findings(count: int = 3600, seed: int = 31, words: Sequence[str] = ()) -> list[tuple[Candidate, bool]]:
    """Labelled findings made by rule: half of them secrets, of which some are made of words as people make them."""
    r = random.Random(seed)
    some = lambda letters, n: "".join(r.choices(letters, k=n))
    word = lambda: r.choice(words) if words and r.random() < 0.5 else r.choice(WORDS)
    spoken = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(2, 4))) + r.choice(("", "n", "r", "s"))
    chosen = lambda: r.choice((
        lambda: word() + some(string.digits, r.randint(1, 4)) + r.choice(("", word(), "!", "#", "_")),
        lambda: word().capitalize() + r.choice("!@#$_-") + some(string.digits, r.randint(2, 4)),
        lambda: some(string.digits, 2) + word() + some(string.digits, 2) + word(),
        lambda: spoken() + some(string.digits, r.randint(1, 3)) + r.choice(("", spoken())),
        lambda: word().replace("e", "3").replace("o", "0").replace("a", "4") + some(string.digits + "!", 3),
    ))()
    upper, alnum, hexa = string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.digits + "abcdef"
    filler = lambda: " ".join(word() for _ in range(r.randint(0, 5))) + " "
    out: list[tuple[Candidate, bool]] = []
    while len(out) < count:
        good = len(out) % 2 == 0
        if good:
            kind, before, value = r.choice((
                ("cloud_key_id", filler(), "AKIA" + some(upper, 16)),
                ("assigned", filler() + r.choice(("password=", "passwd: ", "pwd=", 'secret = "', "db_password=")), some(r.choice((hexa, alnum, alnum + "!@#%_-")), r.randint(8, 24))),
                ("assigned", filler() + r.choice(("password=", "passwd: ", "pwd=", 'password = "', "DB_PASSWORD=", "secret: ")), chosen().ljust(7, "7")),
                ("assigned", filler() + r.choice(('token = "', "token=", "api_key: ", 'API_KEY="', 'access_key = "', "auth_key=")), some(r.choice((hexa, alnum, alnum + "_-")), r.choice((24, 32, 40, 48, 64)))),
                ("prefixed", filler(), r.choice(("ghp_", "sk_live_", "xoxb-", "AIza", "hf_")) + some(alnum, r.randint(24, 40))),
                ("web_token", r.choice(("Bearer ", filler())), f"eyJ{some(alnum, 20)}.{some(alnum, 40)}.{some(alnum, 40)}"),
                ("random", filler() + r.choice(("secret ", "key ", "bearer ", "Bearer ", "private key ", "auth token is ", "Authorization: Bearer ")), some(r.choice((alnum + "+/", alnum, hexa, hexa)), r.choice((32, 40, 44, 48)))),
                ("in_url", r.choice(("postgres://", "https://", "mysql://", "amqp://")), f"{word()}:{r.choice((some(alnum, r.randint(8, 20)), chosen()))}"),
                ("private_key", filler(), "-----BEGIN PRIVATE KEY-----\n" + some(alnum + "+/", 200) + "\n-----END PRIVATE KEY-----"),
            ))
        else:
            kind, before, value = r.choice((
                ("random", r.choice(("commit ", "sha256 ", "md5 ", "checksum: ", "revision ", filler())), some(hexa, r.choice((32, 40, 64)))),
                ("random", r.choice(("uuid ", filler())), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
                ("random", filler(), "-".join([*(word() for _ in range(r.randint(4, 8))), str(r.randint(1, 99))])),
                ("random", filler(), "/".join([*(word() for _ in range(r.randint(4, 8))), f"v{r.randint(1, 9)}"])),
                ("random", filler(), "_".join([*(word() for _ in range(r.randint(4, 8))), str(r.randint(1, 2030))])),
                ("assigned", filler() + r.choice(("password=", "token: ", "secret=", 'api_key = "')), r.choice(("<your_password>", "changeme", "xxxxxxxx", "********", "your-token-here", "example", "${DB_PASSWORD}", "None", "required", "os.environ", "placeholder", word() + word(), "{{secret}}", "0000000000", "process.env.TOKEN"))),
                ("assigned", filler() + r.choice(("token: ", "password: ", "secret: ", "credentials: ")), word() + r.choice(("", ".", ")", "s")) + r.choice(("", word()))),
                ("cloud_key_id", filler(), "AKIA" + r.choice(("IOSFODNN7EXAMPLE", "X" * 16, "0" * 16, "EXAMPLEEXAMPLE" + some(upper, 2), "TESTTESTTESTTEST"))),
                ("prefixed", filler(), r.choice(("sk-", "hf_", "npm_")) + r.choice(("-", "_", "")).join(word() for _ in range(6))),
                ("in_url", "https://", f"{word()}:{r.choice(('password', 'pass', 'your_password', 'xxxx', 'secret'))}"),
                ("random", r.choice(("serial ", "isbn ", "order ", "call ")), some(string.digits, 12) + r.choice("ABX") + some(string.digits, 12)),
            ))
        path = r.choice(("", "", "", "src/app.py", "config/prod.env", "deploy.yml")) if good else r.choice(("", "", "", "tests/test_app.py", "package-lock.json", "docs/example.md", "src/app.py"))
        out.append((Candidate(kind, 0, len(value), value, before[-40:], path), good))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (feature, -1 at a leaf; threshold, left, right, value), and the dictionary of their features."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    known: Dictionary

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                k = np.flatnonzero(inner)
                goes = rows[k, feature[at[k]]] <= threshold[at[k]]
                at[k] = np.where(goes, left[at[k]], right[at[k]])
            out += value[at]
        return out / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, ...]:
    """One tree on a bootstrap sample: at every node the best Gini split among a random few features."""
    nodes: list[list] = []
    tries = max(1, round(x.shape[1] ** 0.5))

    def add(rows: np.ndarray, level: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return k
        best = (np.inf, 0, 0.0)
        for f in rng.permutation(x.shape[1])[:tries]:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones, n = x[order, f], np.cumsum(y[order]), np.arange(1, len(rows) + 1)
            cut = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= least) & (n[:-1] <= len(rows) - least))
            if len(cut):
                a, b = ones[cut], ones[-1] - ones[cut]
                na, nb = n[cut], len(rows) - n[cut]
                impurity = a * (na - a) / na + b * (nb - b) / nb
                j = int(impurity.argmin())
                low, high = float(v[cut[j]]), float(v[cut[j] + 1])
                best = min(best, (float(impurity[j]), int(f), middle if (middle := (low + high) / 2) < high else low))
        if best[0] < np.inf:
            goes = x[rows, best[1]] <= best[2]
            nodes[k][:2] = best[1:]
            nodes[k][2] = add(rows[goes], level + 1)
            nodes[k][3] = add(rows[~goes], level + 1)
        return k

    add(rng.integers(0, len(y), len(y)), 0)
    columns = zip(*nodes, strict=True)
    return tuple(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True))


def labelled(findings: DataFrame, most: int = 20_000) -> list[tuple[Candidate, bool]]:
    """Labelled findings of a table (kind, value, before, path, is_secret), of which at most ``most`` are taken, by a hash of the row."""
    rows = findings.select("kind", "value", "before", F.coalesce("path", F.lit("")).alias("path"), "is_secret").where(F.col("kind").isin(*FORMATS) & F.col("value").isNotNull() & F.col("is_secret").isNotNull())
    taken = rows.orderBy(F.xxhash64("kind", "value", "before"), "value").limit(most).collect()
    return [(Candidate(r.kind, 0, len(r.value), r.value, (r.before or "")[-40:], r.path), bool(r.is_secret)) for r in taken]


def train(findings: Iterable[tuple[Candidate, bool]] | None = None, words: Iterable[str] = (), *, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 12) -> Forest:
    """A forest from labelled findings (of bounded number), by default the generated ones, and a dictionary with the given words."""
    words = sorted({*words})
    known, findings = dictionary(words), list(example_findings(words=words) if findings is None else findings)
    x, y = np.array([vector(c, known) for c, _ in findings]), np.array([float(k) for _, k in findings])
    return Forest(tuple(grow(x, y, np.random.default_rng((seed, k)), depth, least) for k in range(trees)), known)


def judged(text: str, forest: Forest, path: str = "") -> list[tuple[Candidate, float]]:
    found = candidates(text, path)
    return list(zip(found, forest.scores(np.array([vector(c, forest.known) for c in found])), strict=True)) if found else []


def redact(text: str, secrets: list[Candidate]) -> str:
    out, at = [], 0
    for c in secrets:
        out += [text[at : c.start], REPLACEMENT]
        at = c.end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, forest: Forest | None = None, *, least: float = 0.5, text: str = "text", path: Column | None = None) -> DataFrame:
    """docs' columns, then a struct column (``scan`` or a fresh name): clean text, n_candidates, n_secrets, findings.

    A finding reads kind:start:end:score, in code points.
    """
    bounded_batches(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(forest or train())  # of bounded size
    (name,) = fresh(docs, "scan")

    @F.arrow_udf("clean string, n_candidates long, n_secrets long, findings array<string>")
    def looked(texts: pa.Array, paths: pa.Array) -> pa.Array:
        known, out = shipped.value, []
        for body, where in zip(texts.to_pylist(), paths.to_pylist(), strict=True):
            got = judged(body, known, where or "") if body else []
            secrets = [(c, p) for c, p in got if p >= least]
            clean = redact(body, [c for c, _ in secrets]) if secrets else body
            out.append((clean, len(got), len(secrets), [f"{c.kind}:{c.start}:{c.end}:{p:.3f}" for c, p in secrets]))
        give_back()
        a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.list_(pa.string()))], ["clean", "n_candidates", "n_secrets", "findings"])

    return docs.withColumn(name, looked(F.col(text), path if path is not None else F.lit("")))


def report(docs: DataFrame, forest: Forest | None = None, *, key: str = "doc_id") -> DataFrame:
    """One row a document: counts, findings, and the digest of its text without secrets."""
    out = scan(docs, forest)
    got = out.columns[-1]
    return out.select(key, f"{got}.n_candidates", f"{got}.n_secrets", F.array_join(f"{got}.findings", ";").alias("findings"), F.sha2(F.coalesce(f"{got}.clean", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def redacted(docs: DataFrame, forest: Forest | None = None, *, text: str = "text") -> DataFrame:
    """docs with every secret in the text replaced; all rows and columns stay."""
    out = scan(docs, forest, text=text)
    return out.select(*(F.col(f"{out.columns[-1]}.clean").alias(c) if c == text else F.col(c) for c in docs.columns))
