"""Secrets in texts: candidate strings judged by a random forest.

Candidates are long runs of key characters that hold a digit, values assigned to names like
``password``, and the password part of a URL.  Features: length, character classes and
transitions (how likely neighbouring letters are in words), dictionary coverage, path traits,
and the neighbouring words: three before and two behind, within 80 characters.  The forest is
trained on the driver from labelled lines that :func:`findings` draws in many independent forms
(code, configuration, URLs, headers, key blocks; against hashes, identifiers, paths, public
keys, embedded data, placeholders and code that only names secrets); candidates and features
of these lines come from the very expressions that scan texts.  It scores as a column
expression, so the main path has column expressions alone.

The dictionary is the words of a public vocabulary file, whose path is a parameter.

Defined results: a null or empty text has no candidates; overlapping candidates count once,
the assigned value first, then the URL's password; repeated rows each get theirs; a text may
be very long and hold any number of candidates; positions are code points, the end exclusive; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
import string
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm import trees
from pairlens.llm.spans import locate

#: A run of key characters, from its start, that holds a digit.
RUN = r"(?:(?<![A-Za-z0-9+/=_.-])|\G)(?=[A-Za-z+/=_.-]*+[0-9])[A-Za-z0-9+/=_.-]{16,}+"
#: What is assigned to a name that says it is secret.
ASSIGNED = r"(?i)(?<=(?:password|passwd|pwd|secret|token|api_key|apikey|api-key|access_key|private_key)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?)[^\x20\x09-\x0D\"',;:=&]{6,}+"
#: What stands between a user's name and the host of a URL.
IN_URL = r"(?<=://[A-Za-z0-9._-]{1,40}:)[^\x20\x09-\x0D\"'/@:]{4,}+(?=@[A-Za-z0-9])"
URL = r"://[A-Za-z0-9._-]{1,40}:[^\x20\x09-\x0D\"'/@:]{4,}@[A-Za-z0-9]"
SECRET_WORDS = r"key|token|secret|passw|pwd|auth|credential|bearer|private"
HASH_WORDS = r"commit|sha|hash|md5|checksum|digest|uuid|guid|etag|revision|isbn|doi|order|invoice|version|page|id\b|checkout|integrity"
OPEN_WORDS = r"public|certificate|ssh-|base64,|data:|image|font"
THRESHOLD = 0.5
FEATURES = 22
#: Labelled lines drawn in each form, and the dictionary's file.
DRAWS, VOCABULARY = 60, "byte_bpe_50k.json"
_LETTERS = string.ascii_lowercase
_WS = r"\x20\x09-\x0D"


class Dictionary:
    """Lower-case words of four letters or more, and how likely letters follow each other in them."""

    BUCKETS = 1024

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        # An entry that begins a word carries a mark for the space before it.
        self.words = sorted({w[1:].lower() for w in vocabulary if re.fullmatch("Ġ[A-Za-z]{4,}", w)})
        pairs = np.ones((26, 26))
        for w in self.words:
            for a, b in zip(w, w[1:], strict=False):
                pairs[ord(a) - 97, ord(b) - 97] += 1
        self.likely = np.log2(pairs / pairs.sum(1, keepdims=True) * 26).round(4)

    def covered(self, hit: Column) -> Column:
        """The characters of ``hit`` in runs of letters that are words."""
        buckets = [" "] * self.BUCKETS
        for w in self.words:
            buckets[zlib.crc32(w.encode()) % self.BUCKETS] += w + " "
        # One literal: the optimiser splits it once.
        table = F.split(F.lit("\n".join(buckets)), "\n")
        runs = F.transform(F.regexp_extract_all(hit, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0)), F.lower)
        known = F.filter(runs, lambda w: F.instr(F.element_at(table, (F.crc32(w) % self.BUCKETS + 1).cast("int")), F.concat(F.lit(" "), w, F.lit(" "))) > 0)
        return F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w))

    def transitions(self, hit: Column) -> Column:
        """The mean over pairs of neighbouring letters of how much likelier the second is than by chance, in bits."""
        table = F.split(F.lit(" ".join(map(str, self.likely.ravel().tolist()))), " ").cast("array<double>")
        codes = F.transform(F.split(F.lower(hit), ""), lambda c: F.ascii(c) - 97)
        pairs = F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(1))), lambda a, b: F.when(a.between(0, 25) & b.between(0, 25), F.element_at(table, a * 26 + b + 1)))
        values = F.filter(pairs, lambda x: x.isNotNull())
        return F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0))


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, stop, hit and the text around it, for each candidate."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.where(F.col("text").rlike(f"(?i)[0-9]|://|{SECRET_WORDS}"))
    # Looking back from every character is dear: only texts with such a URL are looked at for its password.
    rows = rows.withColumn("url_text", F.when(F.col("text").rlike(URL), F.col("text")).otherwise(""))
    rows = locate(locate(locate(rows, ASSIGNED, "assigned"), IN_URL, "in_url", text="url_text"), RUN, "runs")
    # Two hashes tell texts that share an id apart; rows that repeat as a whole have equal hits.
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2"), *_KINDS)
    lists = [f"transform({name}, x -> named_struct('kind', {k}, 'start', x.start, 'stop', x.stop, 'hit', x.hit, 'tail', x.tail, 'head', x.head))" for k, name in enumerate(_KINDS)]
    every = F.expr(f"concat({', '.join(lists)})")
    return without_overlaps(rows.select("doc_id", "h", "h2", F.explode(every).alias("x")).select("doc_id", "h", "h2", "x.*")).drop("h", "h2", "kind")


#: Lists of candidates; one gives way where it overlaps one of a list before.
_KINDS = ("assigned", "in_url", "runs")


def without_overlaps(hits: DataFrame) -> DataFrame:
    """``hits`` (doc_id, h, h2, kind, start, stop, and others) that overlap no hit of a smaller kind which stays.

    In order of start only the farthest end before and the next start behind can overlap.  Both are running values,
    one in that order and one against it: a frame that looks ahead would begin anew at each row.
    """
    text = W.partitionBy("doc_id", "h", "h2")
    order = text.orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    against = text.orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, -1)
    hits = hits.withColumn("free", F.col("kind") == 0)
    for kind in range(1, len(_KINDS)):
        kept = F.col("free") & (F.col("kind") < kind)
        before = F.max(F.when(kept, F.col("stop"))).over(order)
        behind = F.min(F.when(kept, F.col("start"))).over(against)
        alone = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(behind >= F.col("stop"), F.lit(True))
        hits = hits.withColumn("free", F.when(F.col("kind") == kind, alone).otherwise(F.col("free")))
    return hits.where("free").drop("free")


def features(hit: Column, tail: Column, head: Column, dictionary: Dictionary) -> list[Column]:
    n = F.greatest(F.length(hit), F.lit(1))
    before = F.regexp_extract(F.lower(tail), rf"((?:[^{_WS}]+[{_WS}]+){{0,2}}[^{_WS}]*[{_WS}]*)$", 1)
    behind = F.regexp_extract(F.lower(head), rf"^([^{_WS}]*[{_WS}]*[^{_WS}]*)", 1)

    def share(pattern: str) -> Column:
        return (F.length(hit) - F.length(F.regexp_replace(hit, pattern, ""))) / n

    def marks(pattern: str) -> Column:
        return (F.length(F.regexp_replace(hit, pattern, "$0#")) - F.length(hit)) / n

    distinct = F.size(F.array_distinct(F.split(hit, ""))) / F.least(n, F.lit(40))
    flag = [
        before.rlike(SECRET_WORDS),
        before.rlike(HASH_WORDS),
        before.rlike(OPEN_WORDS),
        behind.rlike(f"{SECRET_WORDS}|{HASH_WORDS}"),
        before.rlike(r"[:=]\s*[\"']?$"),
        before.rlike(r"://[^/ ]*:$") & behind.startswith("@"),
        hit.rlike(r"^[0-9a-fA-F]+$"),
        hit.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-|^[0-9.+-]+$|^[0-9-]+T[0-9.:]+"),
        hit.rlike(r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_|pk_|AIza|glpat-|eyJ)"),
        behind.rlike(r"^[\"',;)]") | before.rlike(r"[\"']$"),
        hit.rlike(r"[(<>{}\[$*]|^(.)\1+[0-9]?$"),
        hit.rlike(r"(?i)^[a-z0-9_.-]*/[a-z0-9_.-]+/|^/|\.[a-z]{2,4}[0-9]?$"),
    ]
    return [
        n.cast("double"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        distinct.cast("double"),
        # Changes between letters and digits, and of case.
        marks(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        marks(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        dictionary.transitions(hit),
        dictionary.covered(hit) / n,
        share(r"[/._-]"),
        *[F.coalesce(f, F.lit(False)).cast("double") for f in flag],
    ]


def findings(seed: int = 5, draws: int = DRAWS, words: list[str] | None = None) -> list[tuple[str, int, int]]:
    """Labelled lines (text, start, stop of its secret); -1, -1 where there is none."""
    r = random.Random(seed)
    words = words or Dictionary().words
    hexa, mixed, b64 = string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def run(n: int, alphabet: str) -> str:
        return "".join(r.choice(alphabet) for _ in range(n))

    def word() -> str:
        return r.choice(words) if r.random() < 0.8 else run(r.randrange(2, 9), _LETTERS)

    def prose() -> str:
        return " ".join(word() for _ in range(r.randrange(5)))

    def number(least: int = 1, most: int = 5) -> str:
        return run(r.randrange(least, most), string.digits)

    def joined(sign: str, least: int = 2, most: int = 6) -> str:
        return sign.join(word() for _ in range(r.randrange(least, most)))

    secrets = [
        lambda: run(r.choice([32, 40, 64]), hexa),
        lambda: run(40, hexa),
        lambda: run(r.randrange(20, 48), mixed),
        lambda: run(r.randrange(40, 88), b64),
        lambda: r.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "AIza"]) + run(r.randrange(20, 40), mixed),
        lambda: "AKIA" + run(16, string.ascii_uppercase + string.digits),
        lambda: "eyJ" + run(30, mixed) + "." + run(60, mixed) + "." + run(40, mixed),
        lambda: run(r.randrange(8, 16), mixed + "!#%") + r.choice(string.digits),
        lambda: word().title() + number(2, 5) + r.choice("!#%") + run(3, mixed),
    ]
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "private_key", "client_secret", "db_password", "passwd"]
    keys = [
        '{n} = "{s}"', "{n} = '{s}'", '"{n}": "{s}",', 'const {n} = "{s}";', 'os.environ["{N}"] = "{s}"', "{N}={s}", "export {N}={s}", "{n}: {s}", "{n} = {s}", "{n}={s} {w}",
        "{w}: {w}\n{n}: '{s}'", "https://{w}:{s}@{w}.com/{w}", "postgres://{w}:{s}@db.{w}.net:5432/{w}", "https://{w}.com/{w}?access_token={s}&{w}=1", "Authorization: Bearer {s}", '-H "X-Api-Key: {s}"',
        "-----BEGIN RSA PRIVATE KEY-----\n{s}", "{w} {n} = \"{s}\" {w}", "the {n} is {s} now",
    ]
    plain = [
        lambda: f"commit {run(40, hexa)}", lambda: f"see commit {run(40, hexa)} for it", lambda: f"git checkout {run(40, hexa)}", lambda: f"sha256:{run(64, hexa)}", lambda: f"md5 = {run(32, hexa)}", lambda: f'"integrity": "sha512-{run(86, b64)}=="',
        lambda: f'etag: "{run(32, hexa)}"', lambda: f"{run(64, hexa)}  {joined('-')}.tar.gz", lambda: f"checksum {run(r.choice([32, 40, 64]), hexa)}", lambda: f"{word()} {run(r.choice([32, 40]), hexa)} {word()}",
        lambda: f"request id {'-'.join(run(n, hexa) for n in (8, 4, 4, 4, 12))}", lambda: f'{word()} = "{"-".join(run(n, hexa) for n in (8, 4, 4, 4, 12))}"', lambda: f"order {number(14, 20)} came", lambda: f"{word()} {number(16, 24)}", lambda: f"at 2024-{number(2, 3)}-{number(2, 3)}T{number(2, 3)}.{number(3, 9)}Z",
        lambda: f"/usr/lib/{joined('/')}/{word()}{number()}.py", lambda: f"https://{word()}.com/{joined('/')}/{joined('-')}-{number()}.html", lambda: f"src/{joined('/')}_{number()}.js", lambda: f"the {joined('/', 3, 7)}/{number()}.html file",
        lambda: f"{joined('_', 3, 6)}_{number()}", lambda: "".join(word().title() for _ in range(r.randrange(2, 5))) + number(), lambda: f"{joined('-', 3, 6)}-{number()}", lambda: f"{word()}.{joined('.', 2, 4)}{number()}.example.com",
        lambda: f"data:image/png;base64,{run(r.randrange(80, 200), b64)}", lambda: f"ssh-rsa AAAAB3Nza{run(120, b64)} {word()}@{word()}", lambda: f"-----BEGIN CERTIFICATE-----\n{run(64, b64)}", lambda: f"-----BEGIN PUBLIC KEY-----\n{run(64, b64)}",
        lambda: f'{r.choice(names)} = "{r.choice(["your", "my", "example", "insert", "test", "dummy", "sample"])}_{joined("_", 1, 4)}{r.choice(["_here", "", "1", "_123"])}"', lambda: f"{r.choice(names)}: changeme{number(0, 4)}", lambda: f"{r.choice(names)}={r.choice('x*X.-')*r.randrange(8, 24)}{number(0, 2)}",
        lambda: f"{r.choice(names)}: <{joined('-', 1, 4)}>", lambda: f"{r.choice(names)}=${{{joined('_').upper()}}}", lambda: f"{r.choice(names)} = {{{{ {joined('.')} }}}}", lambda: f'{r.choice(names)} = os.getenv("{joined("_").upper()}_{number()}")', lambda: f"{r.choice(names)}: process.env.{joined('_').upper()}{number()}",
        lambda: f"{r.choice(names)} = {word()}.{joined('_')}_{number()}()", lambda: f"{r.choice(names)}: {joined('_')}{number(0, 3)}", lambda: f"{r.choice(names)} = None", lambda: f"{r.choice(names)} = {word()}.{word()}", lambda: f"{r.choice(names)}: {joined('-')}",
        lambda: f"https://{word()}:password@{word()}.com/", lambda: f"https://user:{r.choice(['<password>', 'changeme', 'example', '$PASSWORD', '****'])}@{word()}.org/{word()}", lambda: "=" * r.randrange(16, 60) + number(1, 2), lambda: f"{'-' * r.randrange(16, 40)}{number(1, 3)}", lambda: f"isbn 978-{number(1, 2)}-{number(3, 6)}-{number(4, 6)}-{number(1, 2)}",
    ]
    found = []
    for _ in range(draws):
        for form in keys:
            value = r.choice(secrets)() if "BEGIN" not in form else run(64, b64)
            if "the {n} is" in form or "Bearer" in form or "X-Api" in form:
                value = r.choice(secrets[:7])()
            if "://" in form:
                value = r.choice([secrets[2], secrets[7], secrets[8]])().replace("#", "!")
            name = r.choice(names)
            first, last = form.split("{s}")
            fill = {"n": name, "N": name.upper()}
            lead = prose() + r.choice([" ", "\n", ". "])
            first = lead + re.sub(r"\{(.)\}", lambda m: fill.get(m[1]) or word(), first)
            found.append((first + value + re.sub(r"\{(.)\}", lambda m: word(), last) + " " + prose(), len(first), len(first) + len(value)))
        found += [(f"{prose()}{r.choice([' ', chr(10), '. '])}{form()} {prose()}", -1, -1) for form in plain]
    return found


def measured(lines: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Candidates with their features x."""
    found = candidates(lines)
    # The generator computes them once; a projection would go into each step of each tree.
    x = F.array(*features(F.col("hit"), F.col("tail"), F.col("head"), dictionary))
    return found.select("doc_id", "start", "stop", F.explode(F.array(x)).alias("x"))


def labelled(spark: SparkSession, lines: list[tuple[str, int, int]], dictionary: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates of labelled lines; a candidate that overlaps a secret is one."""
    rows = measured(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(lines)], "doc_id long, text string"), dictionary).collect()
    x = np.array([r["x"] for r in rows])
    y = np.array([float(r["start"] < lines[r["doc_id"]][2] and lines[r["doc_id"]][1] < r["stop"]) for r in rows])
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def fit(spark: SparkSession, dictionary: Dictionary | None = None) -> list[trees.Tree]:
    dictionary = dictionary or Dictionary()
    return trees.forest(*labelled(spark, findings(words=dictionary.words), dictionary), trees=32, depth=8)


def scan(docs: DataFrame, forest: list[trees.Tree] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", dictionary: Dictionary | None = None) -> DataFrame:
    """A row for each candidate: doc_id, start, stop, score, secret."""
    dictionary = dictionary or Dictionary()
    forest = forest or fit(docs.sparkSession, dictionary)
    rows = measured(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), dictionary)
    scored = rows.select("doc_id", "start", "stop", F.round(trees.votes(forest, F.col("x")), 6).alias("score"))
    return scored.withColumn("secret", F.col("score") >= threshold)
