"""Personal data: candidate spans scored by boosted trees, as built-in expressions of one projection.

Base spans follow fixed patterns. Further generators propose spans, many of them wrong and some
overlapping; trees fitted on made-up examples score each by its format and context, and thresholds
calibrated on held-out examples select which are added.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import spare, texts

#: Base kinds, in the order of results. As specified, but for possessive repeats and a look-behind, which save retries that must fail.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: kind, the kind of span they add, pattern. Each scans its text once.
GENERATORS = (
    ("mail_words", "email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]{{1,63}}+(?: ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}) ?[A-Za-z0-9-]{{1,63}}+){{1,5}}+"),
    ("digits", "phone", r"(?<![0-9A-Za-z+.,:/-])(?:\(0|0|\()?[0-9](?:[ ().\/-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])"),
    ("national", "national_id", r"(?<![0-9A-Za-z.-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])"),
    ("account", "iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("hex_groups", "ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("opaque", "secret", r"(?<![0-9A-Za-z_+/=.-])(?=[A-Za-z_+/-]{0,99}[0-9])(?=[0-9_+/-]{0,99}[A-Za-z])[0-9A-Za-z_+/-]{16,400}+={0,2}(?![0-9A-Za-z_+/=@-])"),
    ("assigned", "secret", r"(?<=(?i:password|passwd|passwort|passphrase|pwd|secret)\x20?[:=]\x20?[\x22']?)[^\s\x22'<>,;]{6,64}+"),
)
#: The longest span of a generator, and the shortest.
LONGEST, SHORTEST = 490, 6
KINDS = (*BASE, "iban", "national_id", "secret")
CONTEXT = 28
_KEYWORDS = r"(?i)\b(?:phone|tel|telephone|telefon|t[ée]l[ée]fono|t[ée]l[ée]phone|call|mobile|handy|m[óo]vil|fax|ssn|social security|iban|konto|account|compte|cuenta|e-?mail|contact|kontakt|ip|address|adresse)\b"


def _running_sums(values: Column, block: int = 256) -> Column:
    """Sums before each element of an array of ints, in blocks so that long arrays stay cheap."""
    zero = F.lit(0)
    blocks = F.transform(F.sequence(zero, F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))

    def inside(x: Column, base: Column) -> Column:
        start = F.struct(base.alias("n"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(x, start, lambda s, v: F.struct((s["n"] + v).alias("n"), F.concat(s["a"], F.array(s["n"])).alias("a")))["a"]

    def bases(bs: Column) -> Column:
        return F.transform(bs, lambda x, i: F.aggregate(F.slice(bs, 1, i), zero, lambda n, y: n + F.aggregate(y, zero, lambda a, v: a + v)))

    # transform over an array of one binds blocks to a name
    bound = F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(bs, bases(bs), inside)))
    return F.when(F.size(values) > 0, F.get(bound, 0)).otherwise(F.array().cast("array<int>"))


def _located(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """df with an array of (start, end, s) of all leftmost matches, in code points.

    What lies between the matches is what splitting leaves, so lengths give the positions.
    """
    t, p = F.col(text), F.lit(pattern)
    pieces, found, sums = spare(df.columns, "pieces"), spare(df.columns, "found"), spare(df.columns, "sums")
    some = t.rlike(pattern)
    none = F.array().cast("array<string>")
    df = df.withColumns({pieces: F.when(some, F.split(t, pattern, -1)).otherwise(none), found: F.when(some, F.regexp_extract_all(t, p, F.lit(0))).otherwise(none)})
    both = F.zip_with(F.slice(F.col(pieces), 1, F.size(found)), F.col(found), lambda a, b: F.length(a) + F.length(b))
    df = df.withColumn(sums, both)
    before = _running_sums(F.col(sums))
    spans = F.zip_with(before, F.arrays_zip(F.slice(F.col(pieces), 1, F.size(found)).alias("gap"), F.col(found).alias("s")), lambda n, x: F.struct(
        (n + F.length(x["gap"])).alias("start"), (n + F.length(x["gap"]) + F.length(x["s"])).alias("end"), x["s"].alias("s")))
    return df.withColumn(out, spans).drop(pieces, found, sums)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = F.reverse(_digits(s))

    def add(n: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return n + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    n = F.length(_digits(s))
    if kind == "card":
        return n.between(13, 19) & _luhn(s)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: Features of a candidate c (kind, s, before, after): whole numbers, so that a few cuts describe them all.
FEATURES = {
    "kind": lambda c: F.array_position(F.array(*(F.lit(g[0]) for g in GENERATORS)), c["kind"]).cast("int"),
    "digits": lambda c: F.least(F.length(_digits(c["s"])), F.lit(30)),
    "length": lambda c: F.least(F.length(c["s"]), F.lit(60)),
    "separators": lambda c: F.least(F.length(F.regexp_replace(c["s"], "[0-9A-Za-z]", "")), F.lit(12)),
    "groups": lambda c: F.least(F.size(F.split(c["s"], "[^0-9A-Za-z]+")), F.lit(9)),
    "letters": lambda c: F.least(F.length(F.regexp_replace(c["s"], "[^A-Za-z]", "")), F.lit(30)),
    "dots": lambda c: F.least(F.length(F.regexp_replace(c["s"], "[^.]", "")), F.lit(9)),
    "slashes": lambda c: F.least(F.length(F.regexp_replace(c["s"], "[^/]", "")), F.lit(4)),
    "colons": lambda c: F.least(F.length(F.regexp_replace(c["s"], "[^:]", "")), F.lit(9)),
    "parenthesis": lambda c: c["s"].rlike(r"^\(|[0-9] \([0-9]").cast("int"),
    "leading_zero": lambda c: c["s"].rlike(r"^\(?0").cast("int"),
    "date_like": lambda c: c["s"].rlike(r"(?:19|20)[0-9]{2}[ ./-][0-3]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{2}").cast("int"),
    "keyword": lambda c: c["before"].rlike(_KEYWORDS).cast("int"),
    "assignment": lambda c: c["before"].rlike(r"[=#№$€£]\s?$|(?i)(?:no|nr|id|isbn|ref|order|version|v)\.?:? ?$").cast("int"),
    "unit_after": lambda c: c["after"].rlike(r"^ ?(?:%|[€$£]|(?:km|kg|m|eur|usd|px|ms|am|pm|h)\b)").cast("int"),
    "secret_word": lambda c: c["before"].rlike(r"(?i)(?:token|secret|passw[a-z]*|passphrase|pwd|credentials?|bearer|auth|(?:api|access|private|license)[ _-]?key)[^A-Za-z0-9]{1,5}$").cast("int"),
    "digest_word": lambda c: c["before"].rlike(r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|revision|digest|hash|etag|uuid|guid|file|image|build|version|id|index)[^A-Za-z0-9]{1,4}$").cast("int"),
    "secret_prefix": lambda c: c["s"].rlike("^(?:A[KS]IA[0-9A-Z]{16}$|gh[pousr]_|[sp]k_(?:live|test)_|xox[abprs]-|AIza|glpat-|eyJ)").cast("int"),
    "lower_hex": lambda c: c["s"].rlike("^[0-9a-f]+$").cast("int"),
    "switches": lambda c: F.least(F.size(F.split(c["s"], "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")), F.lit(15)),
    "marks": lambda c: F.least(F.length(F.regexp_replace(c["s"], "[^_+/-]", "")), F.lit(9)),
    "uuid": lambda c: c["s"].rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-").cast("int"),
    "upper": lambda c: F.least(F.length(F.regexp_replace(c["s"], "[^A-Z]", "")), F.lit(20)),
    "known_country": lambda c: c["s"].rlike("^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)").cast("int"),
}


def _in_context(text: str, name: str, adds: str):
    return lambda x: F.struct(
        F.lit(name).alias("kind"), F.lit(adds).alias("adds"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"),
        F.substring(F.col(text), F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT))).alias("before"),
        F.substring(F.col(text), x["end"] + 1, F.lit(8)).alias("after"))


def _candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with all generators' spans: kind, adds, start, end, s and the text before and after."""
    arrays = []
    for name, adds, pattern in GENERATORS:
        column = spare(df.columns, f"g_{name}")
        df = _located(df, text, pattern, column)
        arrays.append(F.transform(column, _in_context(text, name, adds)))
    return df.withColumn(out, F.concat(*arrays))


# --- the model -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A split (feature, most for the left side) or a leaf's value."""

    value: float = 0.0
    feature: int = -1
    most: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def column(self, features: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(features[self.feature] <= self.most, self.left.column(features)).otherwise(self.right.column(features))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.most, self.left.score(x), self.right.score(x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float = 1.0) -> Tree:
    leaf = Tree(value=float(-rate * g.sum() / (h.sum() + ridge)))
    best, choice = 1e-6, None
    if depth:
        whole = g.sum() ** 2 / (h.sum() + ridge)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            sums = np.array([(g[x[:, f] == v].sum(), h[x[:, f] == v].sum()) for v in values]).cumsum(0)
            for v, (gl, hl) in zip(values[:-1], sums[:-1]):
                gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
                if gain > best + 1e-9:
                    best, choice = gain, (f, int(v))
    if choice is None:
        return leaf
    side = x[:, choice[0]] <= choice[1]
    return Tree(feature=choice[0], most=choice[1], left=_grow(x[side], g[side], h[side], depth - 1, rate), right=_grow(x[~side], g[~side], h[~side], depth - 1, rate))


@dataclass(frozen=True)
class Boosted:
    """Trees whose sum is a log odds, and for each kind of candidate the least sum that is accepted."""

    trees: tuple[Tree, ...]
    least: dict[str, float]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, kinds: list[str], rounds: int = 25, depth: int = 3, rate: float = 0.4, precision: float = 0.99) -> Boosted:
        """Newton boosting on two thirds of the examples; thresholds from the rest."""
        calibrate = np.arange(len(y)) % 3 == 2
        a, b = x[~calibrate], y[~calibrate]
        score, trees = np.zeros(len(b)), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            trees.append(_grow(a, p - b, p * (1 - p), depth, rate))
            score = score + trees[-1].score(a)
        held = sum(t.score(x[calibrate]) for t in trees)
        least = {}
        for kind in dict.fromkeys(kinds):
            mine = np.array([k == kind for k in kinds])[calibrate]
            s, t = held[mine], y[calibrate][mine]
            # the least sum from which on all higher ones are right often enough, and likelier right than not
            fine = [v for v in np.unique(s) if v > 0 and t[s >= v].mean() >= precision]
            least[kind] = float(min(fine)) if fine else float("inf")
        return cls(tuple(trees), least)

    def accepted(self, c: Column) -> tuple[Column, Column]:
        """The score of a candidate with its features, and the least that is accepted."""
        features = [c[f"f_{n}"] for n in FEATURES]
        score = reduce(lambda a, b: a + b, (t.column(features) for t in self.trees))
        least = reduce(lambda a, k: F.when(c["kind"] == k, F.lit(self.least[k])).otherwise(a), self.least, F.lit(float("inf")))
        return score, least


def _examples(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Made-up texts with one span each that is (1) or is not (0) personal data: text, start, end, label. From rules and a seed."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9)))
    quad = lambda: "".join(r.choice("0123456789") for _ in range(4))
    hint = lambda *w: r.choice(w) + r.choice([": ", " ", ". "])
    text = lambda k, of: "".join(r.choice(of) for _ in range(k))
    hexed, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: r.choice(["token", "api_key", "apikey", "secret", "access_token", "client_secret", "auth token", "API key", "private_key", "SECRET_KEY", "Bearer"])
    given = lambda: r.choice([(' = "', '"'), ("=", ""), (": ", ""), (": '", "'"), ('="', '"'), (" ", "")])
    opaque = lambda: r.choice([text(32, hexed), text(40, hexed), text(64, hexed), text(r.randint(20, 60), mixed), text(r.randint(24, 44), mixed + "+/")])

    def secret():
        (a, b), k = given(), key()
        return k + a, opaque(), b

    yes = [
        secret, secret,
        lambda: (r.choice(["", "use ", "key "]), r.choice(["AKIA" + text(16, mixed[:26] + "0123456789"), "ghp_" + text(36, mixed), "sk_live_" + text(24, mixed), "xoxb-" + d(11) + "-" + text(24, mixed), "AIza" + text(35, mixed)])),
        lambda: (r.choice(["password: ", "Password=", "passwd = ", "pwd: ", "Passwort: "]), text(r.randint(5, 12), mixed) + r.choice("!$%&*?") + d(2)),
        lambda: (hint("mail", "Contact", "e-mail", ""), f"{name()}{r.choice(['', '.' + name()])}{r.choice([' (at) ', '(at)', ' [at] ', '[at]'])}{name()}{r.choice([' (dot) ', '[dot]', '.', ' [dot] '])}{r.choice(['com', 'org', 'de', 'example'])}"),
        lambda: (hint("Phone", "Tel", "call", "Telefon", "fax", "mobile"), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(3)}/{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}"])),
        lambda: (r.choice(["", "reach us at ", "or "]), f"({r.randint(200, 999)}) {d(3)}-{d(4)}"),
        lambda: (hint("SSN", "social security", "ssn"), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (hint("IBAN", "Konto", "account", ""), f"{r.choice(['DE', 'FR', 'ES', 'GB', 'NL', 'IT', 'AT'])}{d(2)}" + "".join(f" {quad()}" for _ in range(r.randint(4, 5))) + r.choice(["", f" {d(2)}"])),
        lambda: (hint("IBAN", "iban"), f"{r.choice(['DE', 'FR', 'ES'])}{d(2)}{d(16)}"),
        lambda: (hint("IP", "address", ""), ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8))),
    ]
    no = [
        lambda: (r.choice(["commit ", "sha1 ", "sha256: ", "md5 ", "checksum ", "revision ", "digest ", "hash = ", "image ", "at ", "see ", ""]), text(r.choice([20, 32, 40, 64]), hexed)),
        lambda: (r.choice(["", "id ", "uuid: "]), "-".join(text(k, hexed) for k in (8, 4, 4, 4, 12))),
        lambda: (r.choice(["", "file ", "in "]), "-".join(r.choice([name(), name(), d(4)]) for _ in range(5)) + "-v" + d(1)),
        lambda: (r.choice(["", "class "]), "".join(name().capitalize() for _ in range(3)) + d(1) + name().capitalize()),
        lambda: (r.choice(["", "path "]), "/".join(name() for _ in range(4)) + d(2)),
        lambda: (r.choice(["password: ", "secret: "]), r.choice(["required", "forgotten", "optional", name()])),
        lambda: (hint("order", "No", "ref", "id", ""), r.choice([d(8), d(10), d(12), f"{d(4)}-{d(6)}", f"{d(2)}-{d(7)}"])),
        lambda: (r.choice(["on ", "am ", "le ", ""]), r.choice([f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"1{d(1)}.0{r.randint(1, 9)}.20{d(2)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)} 1{d(1)}", f"1{d(1)}/0{r.randint(1, 9)}/20{d(2)}"])),
        lambda: (r.choice(["", "ISBN "]), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"), lambda: ("", d(r.randint(7, 15))), lambda: ("", f"{d(4)} {d(4)} {d(4)} {d(3)}"),
        lambda: ("version ", ".".join(d(r.randint(1, 3)) for _ in range(5))), lambda: ("", f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(2)}"),
        lambda: (r.choice(["costs ", "$", "€ "]), f"{r.randint(1, 9)}{d(2)}.{d(3)}.{d(3)}"), lambda: ("", f"1{d(3)}-1{d(3)} 20{d(2)}"),
        lambda: ("", f"{d(3)} {d(2)} {d(4)}"), lambda: ("scores ", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"), lambda: ("at ", ":".join([d(2), d(2), d(2), d(2)])),
        lambda: ("", "".join(r.choice(["AB", "XQ", "KP", "ZZ"])) + d(2) + " " + " ".join("".join(r.choice("ABCDEFGH0123456789") for _ in range(4)) for _ in range(r.randint(2, 4)))),
        lambda: ("mac ", ":".join("".join(r.choice("0123456789abcdef") for _ in range(2)) for _ in range(6))),
        lambda: ("we met ", f"{name()} (at) {name()} . {name()}"), lambda: ("", f"{d(1)} - {d(3)} {d(3)}"),
    ]
    words = lambda k: " ".join(name() for _ in range(k))
    out = []
    for k in range(n):
        label = k % 2
        lead, span, *tail = r.choice(yes if label else no)()
        head = f"{words(r.randint(1, 5))} {lead}"
        out.append((f"{head}{span}{''.join(tail)} {words(r.randint(1, 4))}", len(head), len(head) + len(span), label))
    return out


@cache
def _trained(app: str, n: int) -> Boosted:
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(_examples(n), "text string, a int, b int, label int")
    found = _candidates(rows, "text", "c").select("text", "a", "b", "label", F.explode("c").alias("c"))
    c = F.col("c")
    table = found.select("text", "a", "b", "label", c["kind"].alias("k"), c["start"].alias("s"), c["end"].alias("e"), *(f(c).alias(f"f_{x}") for x, f in FEATURES.items())).collect()
    table.sort(key=lambda r: (zlib.crc32(r.text.encode()), r.s, r.k))
    x = np.array([[r[f"f_{n}"] for n in FEATURES] for r in table])
    y = np.array([r.label and r.s == r.a and r.e == r.b for r in table], float)
    return Boosted.fit(x, y, [r.k for r in table])


def model(spark: SparkSession, n: int = 4000) -> Boosted:
    """The trees, fitted on n made-up examples, which pass through the same expressions as texts do."""
    return _trained(spark.sparkContext.applicationId, n)


# --- the operator --------------------------------------------------------------------------------


def _valid_spans(kind: str) -> Column:
    valid = F.filter(f"m_{kind}", lambda x: _valid(kind, x["s"]))
    return F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _of(kind: str):
    return lambda x: x["kind"] == kind


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, _of(kind))).cast("bigint")


def find(docs: DataFrame, trees: Boosted | None = None) -> DataFrame:
    """doc_id, text, base and spans (arrays of kind, start, end; code points, end exclusive) for every row of docs.

    Base spans are the valid matches of BASE by kind, then start; kinds may overlap. spans has
    those and the added ones, which overlap neither a base span nor a better added one. Null text
    is empty and has none. Rows are independent; other columns are ignored.
    """
    trees = trees or model(docs.sparkSession)
    rows = texts(docs)
    for kind, pattern in BASE.items():
        rows = _located(rows, "text", pattern, f"m_{kind}")
    typed = "array<struct<kind:string,start:int,end:int>>"
    base = [_valid_spans(k) for k in BASE]
    rows = rows.withColumn("base", F.concat(*base).cast(typed)).select("doc_id", "text", "base")
    rows = _candidates(rows, "text", "c")
    known = F.transform("c", lambda c: F.struct(c["kind"].alias("kind"), c["adds"].alias("adds"), c["start"].alias("start"), c["end"].alias("end"), *(f(c).alias(f"f_{n}") for n, f in FEATURES.items())))
    scored = F.transform(known, lambda c: F.struct(c["adds"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *(x.alias(n) for x, n in zip(trees.accepted(c), ("score", "least")))))
    rows = rows.withColumn("chosen", F.array_sort(F.transform(F.filter(scored, lambda x: x["score"] >= x["least"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["score"].alias("score")))))
    rows = rows.withColumn("places", F.array_sort(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))))
    # one generator's spans don't overlap: of each, whatever overlaps a span starts within LONGEST places of it, and so many have room there
    reach = len(GENERATORS) * (LONGEST // SHORTEST + 2)
    near = lambda i: F.slice(F.col("chosen"), F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
    better = lambda x, y: (y["score"] > x["score"]) | (y["score"] == x["score"]) & ((y["end"] - y["start"] > x["end"] - x["start"]) | (y["end"] - y["start"] == x["end"] - x["start"]) & ((y["start"] < x["start"]) | (y["start"] == x["start"]) & (y["kind"] < x["kind"])))
    meets = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    free = F.filter("chosen", lambda x, i: ~F.exists(near(i), lambda y: meets(x, y) & better(x, y)) & ~F.exists("places", lambda y: meets(x, y)))
    rows = rows.withColumn("free", free)
    all_ = [F.array_sort(F.filter(F.concat("base", F.transform("free", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))), _of(k))) for k in KINDS]
    return rows.select("doc_id", "text", "base", F.concat(*all_).cast(typed).alias("spans"))


def written(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[%s]") -> DataFrame:
    """doc_id and text with every span replaced by its kind; overlapping spans become one, of the first's kind."""
    rows = find(docs)
    rows = rows.withColumn("order", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        label = F.format_string(mark, x["kind"])
        out = F.when(fresh, F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), label)).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    rows = rows.withColumn("done", F.aggregate("order", start, step))
    return rows.select("doc_id", F.concat(F.col("done.out"), F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))).alias("text"))
