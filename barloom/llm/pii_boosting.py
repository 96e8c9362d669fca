"""Personal data in texts: fixed base rules, and candidates that boosted trees choose from.

Generators with high recall propose overlapping spans: numbers with separators, spelled-out mail addresses,
account numbers and so on. Each candidate gets features of its format (digits, groups, separators,
checksums) and of its context (cue words before it, the characters around it). Gradient-boosted trees, fitted on labelled
examples, score it; a threshold for each kind, calibrated on examples held out, selects. Base spans always stay;
a selected span that meets one gives way.

Everything runs as columns inside the row: no shuffle, no Python on the way. Positions come from the lengths of the
text between matches. The fit sees a bounded number of made-up examples set in prose of the corpus; the
trees are then constants of the plan.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrays import folded, running
from barloom.llm.samples import smallest

#: Bounds of the fit: documents that lend prose, and examples made of each template.
FIT_DOCUMENTS, COPIES = 300, 24
TREES, DEPTH, RATE, PRECISION = 40, 3, 0.3, 0.99
CONTEXT, AFTER = 40, 12

#: Base kinds in the order they are listed: a cheap test of the text, and the expression. Possessive forms match the same
#: as plain ones here, without deep recursion; a mail address can only begin where its run of characters does or the last match ended.
BASE: dict[str, tuple[str, str]] = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
ALONE = r"(?<![0-9A-Za-z._%+@/:#-])"
#: Kinds the method adds, in the order they are listed after the base ones.
ADDED: dict[str, tuple[str, str]] = {
    "email_text": (r"(?i)(?:\bat\b|\barroba\b|@).{0,80}(?:\bdot\b|\bpunto\b|\.)",
                   r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}|<at>| at | arroba | @ ) ?[a-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>| dot | punto |\.) ?[a-z0-9-]{2,63}+){1,4}"),
    "phone_local": (r"[0-9][ ()./-]{0,3}[0-9]",
                    ALONE + r"(?:00[0-9]{1,3}[ ./-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-]{0,3})[0-9]{2,8}+(?:[ ./-][0-9]{2,4}+){0,4}(?![0-9A-Za-z])"),
    "card_text": (r"[0-9]{4}[._/– ]", ALONE + r"[0-9]{4}(?:[._/– ]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])"),
    "id_number": (r"[0-9]{2,3}[- ][0-9]{2}[- ][0-9]{3,4}", ALONE + r"[0-9]{2,3}[- ][0-9]{2}[- ][0-9]{3,4}(?![0-9A-Za-z-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "ip6": (r":[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"),
    "birth_date": (r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}",
                   ALONE + r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9A-Za-z])"),
}
#: Cue words looked for in the characters before a candidate: fixed values.
CUES: dict[str, str] = {
    "cue_phone": r"\b(?:phone|call|tel|mobile|cell|fax|dial|text me|reach|whatsapp|sms|telefon|handy|ruf|anruf|t[ée]l[ée]phone|t[ée]l|appel|portable|tel[ée]fono|m[óo]vil|llam)",
    "cue_mail": r"\b(?:mail|e-mail|contact|write|reach|correo|kontakt|schreib|courriel|[ée]cri)",
    "cue_card": r"\b(?:card|visa|mastercard|amex|credit|debit|cvv|karte|carte|tarjeta)",
    "cue_id": r"\b(?:ssn|social security|tax id|passport|national id|identity|insurance no|nino|ausweis|s[ée]curit[ée] sociale|seguro social|dni)",
    "cue_account": r"\b(?:iban|account|bank|konto|compte|cuenta|transfer|bic)",
    "cue_birth": r"\b(?:born|birth|dob|birthday|geboren|geburt|n[ée]e? le|naissance|nacid|nacimiento)",
    "cue_host": r"\b(?:host|address|server|ip|ipv6|client|login|adresse|connect|direcci)",
    "cue_other": r"\b(?:version|release|build|order|invoice|isbn|issn|serial|part|item|sku|ref|page|pp|vol|article|section|chapter|price|total|model|lot|batch|ticket|case|code|no|nr|number|since|until|from|between|at|date|dated|updated|published|posted|time|score|coordinates|lat|eur|usd)\b\W*$|[$€£%#=]\s*$",
}
FORMAT = ("n_chars", "n_digits", "n_letters", "n_groups", "longest", "n_space", "n_dash", "n_dot", "n_colon", "n_slash", "bracket", "zero", "luhn", "mod97", "double_colon", "at_sign", "known_end",
          "before_kind", "after_kind")
FEATURES = (*FORMAT, *CUES, *[f"is_{k}" for k in ADDED])


def with_matches(docs: DataFrame, text: str, name: str, guard: str, pattern: str, context: bool) -> DataFrame:
    """``docs`` with column ``name``: start, end (code points, end exclusive), value and, if asked, the characters before and after of all matches."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    may = plain.contains(guard) if guard == "@" else plain.rlike(guard)
    docs = docs.withColumn("__values__", F.when(may, F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("__between__", F.when(F.size("__values__") > 0, F.split(plain, pattern, -1)).otherwise(F.array().cast("array<string>")))
    steps = F.transform("__values__", lambda v, i: (F.length(v) + F.length(F.col("__between__")[i])).cast("long"))
    docs = docs.withColumn("__steps__", steps).withColumn("__starts__", running(F.col("__steps__")))

    def span(v: Column, i: Column) -> Column:
        start = F.col("__starts__")[i] + F.length(F.col("__between__")[i])
        fields = [start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value")]
        if context:
            fields += [F.lower(F.right(F.col("__between__")[i], F.lit(CONTEXT))).alias("before"), F.left(F.col("__between__")[i + 1], F.lit(AFTER)).alias("after")]
        return F.struct(*fields)

    return docs.withColumn(name, F.transform("__values__", span)).drop("__values__", "__between__", "__steps__", "__starts__")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a short string of digits passes the check: every second digit from the right is doubled, less 9 above 9."""
    back = F.reverse(number)
    doubled = F.translate(back, "0123456789", "0246813579")
    one = lambda i: F.substring(F.when(i % 2 == 0, doubled).otherwise(back), i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda t, i: t + one(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """Remainder 1 of the account number with its first four characters moved to the end, letters as 10 to 35."""
    compact = F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    def step(t: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (t * 100 + c - 55) % 97).otherwise((t * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    """The test a base match must pass."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(value)).between(14, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_of(value: Column, characters: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, f"[{characters}]", ""))


def measured(c: Column, kind: str) -> list[Column]:
    """Numbers that the trees see of candidate ``c`` (start, end, value, before, after), in the order of FEATURES."""
    v, number = c["value"], digits(c["value"])
    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    edge = lambda ch: F.when(ch == "", 0).when(ch.rlike(r"^\s$"), 1).when(ch.rlike("^[0-9]$"), 4).when(ch.rlike(r"^\p{L}$"), 3).otherwise(2)
    checked = F.length(number).between(12, 19)
    fmt = [F.length(v), F.length(number), count_of(v, "A-Za-z"), F.size(groups), F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
           count_of(v, r"  "), count_of(v, r"\-–"), count_of(v, "."), count_of(v, ":"), count_of(v, "/"), flag(v.rlike(r"[(\[{<]")), flag(v.startswith("0")),
           F.when(checked, flag(luhn(number))).otherwise(0), flag(mod97(v)) if kind == "iban" else F.lit(0), flag(v.contains("::")), flag(v.contains("@")), flag(v.rlike("(?i)(?:com|org|net|edu|info|io|de|fr|es|uk|eu)$")),
           edge(F.right(c["before"], F.lit(1))), edge(F.left(c["after"], F.lit(1)))]
    return [*fmt, *[flag(c["before"].rlike(p)) for p in CUES.values()], *[F.lit(int(k == kind)) for k in ADDED]]


Tree = tuple | float


@dataclass(frozen=True)
class PiiModel:
    """Trees of (feature, threshold, at most, above) with numbers as leaves, and the least score of each added kind."""

    bias: float
    trees: tuple[Tree, ...]
    thresholds: dict[str, float]

    def score(self, x: Column) -> Column:
        def walk(node: Tree) -> Column:
            return F.lit(float(node)) if not isinstance(node, tuple) else F.when(x[node[0]] <= node[1], walk(node[2])).otherwise(walk(node[3]))

        return sum((walk(t) for t in self.trees), F.lit(self.bias))

    def plain_score(self, row: list[int]) -> float:
        def walk(node: Tree) -> float:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return self.bias + sum(map(walk, self.trees))


def grown(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, rate: float) -> Tree:
    """A tree for the gradient sums: the split of every node has the largest gain of all features and values."""
    if depth and len(x) > 1:
        whole = slope.sum()**2 / (bend.sum() + 1)
        best = (1e-6, 0, 0)
        for f in range(x.shape[1]):
            values, place = np.unique(x[:, f], return_inverse=True)
            if len(values) > 1:
                g, h = (np.cumsum(np.bincount(place, w, len(values)))[:-1] for w in (slope, bend))
                gain = g**2 / (h + 1) + (slope.sum() - g)**2 / (bend.sum() - h + 1) - whole
                best = max(best, (float(gain.max()), f, float(values[int(gain.argmax())])))
        if best[1:] != (0, 0):
            left = x[:, best[1]] <= best[2]
            return (best[1], best[2], *(grown(x[s], slope[s], bend[s], depth - 1, rate) for s in (left, ~left)))
    return float(-rate * slope.sum() / (bend.sum() + 1))


def boosted(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, precision: float = PRECISION) -> PiiModel:
    """Newton steps of the logistic loss on two thirds of the rows; the rest sets for each kind the lowest score at and above which ``precision`` is kept."""
    held = np.arange(len(x)) % 3 == 0
    a, b = x[~held], y[~held].astype(float)
    bias = float(np.log((b.sum() + 1) / (len(b) - b.sum() + 1)))
    total, out = np.full(len(a), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        out.append(grown(a, p - b, p * (1 - p), depth, rate))
        one = PiiModel(0.0, (out[-1],), {})
        total += [one.plain_score(r) for r in a.tolist()]
    model = PiiModel(bias, tuple(out), {})
    scores = np.array([model.plain_score(r) for r in x[held].tolist()])
    thresholds = {}
    for kind in ADDED:
        own = kinds[held] == kind
        s, hit = scores[own], y[held][own].astype(bool)
        # halfway to the next lower example, and never below even odds
        good = [t for t in sorted(set(s)) if hit[s >= t].mean() >= precision]
        below = [t for t in s if good and t < good[0]]
        thresholds[kind] = max(0.0, (good[0] + max(below)) / 2 if below else good[0]) if good else float("inf")
    return PiiModel(bias, tuple(out), thresholds)


#: Labelled examples: kind, whether personal, and forms in which # is a digit, % a digit from 1, ? a capital, & a hexadecimal digit,
#: ~ a small word, * a checked number and ^ an unchecked one of the form before the bar. Fixed values.
EXAMPLES: tuple[tuple[str, bool, tuple[str, ...]], ...] = (
    ("phone_local", True, (
        "call me at (%##) ###-####", "phone: %##-###-####", "Tel. 0## #######", "mobile %##.###.####", "fax 0### ######", "(%##) %##-####", "my number is (%##) ###-####",
        "text me %##-###-####", "Telefon 0## / ######", "tél 0# ## ## ## ##", "appelle 0% ## ## ## ##", "teléfono %## ## ## ##", "móvil %## ### ###", "Handy 01## #######",
        "reach us on 00%# ## #######", "whatsapp 00%# %## ######", "dial %##-####", "%##-%##-####", "(0##) ### ####", "phone 0#### ######", "cell %########")),
    ("phone_local", False, (
        "order %#######", "pages %##-###", "invoice 0####-###", "between %### and", "from 19##-19## ", "ISBN 978-%-##-######", "model %##-###", "part no. ###-####", "price % ###.##",
        "version %#.##.##", "in %### ####", "score ##-##", "## ## ##", "total %## ###", "ticket %##-###-####", "serial ###-###-####", "coordinates ##.#### ##.####", "ref %##.###.####",
        "a %### ### ~", "id %#########", "~ %####### ~", "lot ###-##-###", "posted %#.##.20##", "19##/20##", "~ ###-### ~", "page ### / ###", "%## ### ###", "code %##-###-####")),
    ("email_text", True, (
        "mail ~ at ~ dot com", "write to ~.~ [at] ~ [dot] org", "~ (at) ~ (dot) net", "contact ~## at ~ dot com", "~ [at] ~.com", "e-mail: ~ at ~.org", "correo ~ arroba ~ punto com", "~{at}~{dot}de",
        "~ @ ~.com", "reach ~ at ~ dot io", "~<at>~<dot>com")),
    ("email_text", False, (
        "look at ~.~ now", "meet at ~ dot ~", "~ at ~. ~ then", "dinner at ~.~", "stand at ~ . ~", "arrive at ## . ~", "~ at home. the ~", "was at ~.the ~", "they at ~ dot the", "it was at ~.~ ~")),
    ("card_text", True, ("card ####.####.####.####|*", "visa ####/####/####/####|*", "pay with ####_####_####_####|*", "~ ####–####–####–####|*", "karte ####.####.####.####|*")),
    ("card_text", False, ("####.####.####.####|^", "serial ####.####.####.####|^", "code ####/####/####/####|^", "years 19##/19##/20##/20##|^", "card ####.####.####.####|^")),
    ("id_number", True, ("SSN %##-##-####", "social security number %##-##-####", "tax id %##-##-####", "ssn: %## ## ####", "seguro social %##-##-####", "his ssn is %##-##-####", "national id %##-##-####")),
    ("id_number", False, ("part %##-##-####", "~ %##-##-#### ~", "lot ##-##-####", "on ##-##-####", "order %##-##-####", "dated ##-##-####", "%## ## ####", "item ###-##-###", "model %## ## ###")),
    ("iban", True, ("IBAN DE## #### #### #### #### ##|*", "account GB## ???? #### #### #### ##|*", "FR## #### #### #### #### #### ###|*", "konto DE####################|*", "NL## ???? #### #### ##|*")),
    ("iban", False, ("code AB## #### #### ####|^", "serial XK## ???? #### #### ####|^", "DE## #### #### #### #### ##|^", "key ??##?###??##?###", "part ??## #### ####|^", "model ??##????####????")),
    ("ip6", True, ("host 2001:db8:&&&&:&&&&:&&&&:&&&&:&&&&:&&&&", "address fe80::&&&&:&&&&:&&&&:&&&&", "server 2001:&&&:&&&&::&&&&", "~ 2a02:&&&&:&&&&:&&&&:&&&&:&&&&:&&&&:&&&& ~", "login from 2001:db8::&&&&")),
    ("ip6", False, ("at ##:##:##", "time 1#:##:##", "~ ::~", "ratio #:#:#", "date ##:##:####", "~:: ~", "clock ##:##:## ~", "chapter ##:##:##", "mac &&:&&:&&:&&:&&:&&", "std::be:", "1:2:3:4:5")),
    ("birth_date", True, ("born %.%.19##", "born on 0%/0%/19##", "DOB 19##-0%-1#", "date of birth: 1#/1%/19##", "geboren am 1#.0%.19##", "né le 1#/0%/19##", "fecha de nacimiento 1#/0%/19##", "birthday 0%-1#-19##")),
    ("birth_date", False, ("on 0%/1#/20##", "updated 20##-0%-1#", "published %.1%.20##", "version 1#.0%.##", "~ 1#.0%.20## ~", "from 0%/0%/20##", "posted 19##-1%-2#", "~ 19##-0%-0# ~", "dated 1#/0%/19##",
                            "release 1#.1#.##")),
)


def passes_luhn(number: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + 2 * int(c) % 10 for i, c in enumerate(reversed(number))) % 10 == 0


def passes_mod97(value: str) -> bool:
    compact = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def filled(form: str, kind: str, words: list[str], rng: random.Random) -> str:
    """A text of the form; checked and unchecked numbers are drawn until they are."""
    form, _, check = form.partition("|")
    draw = {"#": string.digits, "%": "23456789", "?": string.ascii_uppercase, "&": "0123456789abcdef"}
    while True:
        out = "".join(rng.choice(draw[c]) if c in draw else rng.choice(words) if c == "~" else c for c in form)
        number = out[next((i for i, c in enumerate(form) if c in "#%?" or c.isupper() and form[i + 1:i + 2].isupper() and kind == "iban" and form[i + 2:i + 3] == "#"), 0):]
        if not check or (passes_mod97(number) if kind == "iban" else passes_luhn("".join(c for c in number if c.isdigit()))) == (check == "*"):
            return out
        if kind == "iban" and check == "*":
            # the two check digits follow from the rest
            at = len(out) - len(number)
            body = number[:2] + "00" + number[4:]
            compact = body.replace(" ", "")
            rest = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97
            return out[:at] + number[:2] + f"{98 - rest:02d}" + number[4:]


def examples(prose: list[str], copies: int = COPIES, seed: int = 7) -> list[tuple[str, str, bool]]:
    """(text, kind, personal): every form ``copies`` times, half of them between words of the corpus."""
    rng = random.Random(seed)
    words = sorted({w for p in prose for w in p.lower().split() if w.isascii() and w.isalpha() and 2 < len(w) < 12}) or ["some", "plain", "words", "here"]
    out = []
    for kind, personal, forms in EXAMPLES:
        for form in forms:
            for _ in range(copies):
                around = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(2)]
                out.append((f"{around[0]} {filled(form, kind, words, rng)}{rng.choice(['', '.', ',', ' '])} {around[1]}".strip(), kind, personal))
    rng.shuffle(out)
    return out


def candidates(docs: DataFrame, text: str, name: str = "candidates") -> DataFrame:
    """``docs`` with an array of kind, start, end and features of all that the generators propose."""
    for kind, (guard, pattern) in ADDED.items():
        docs = with_matches(docs, text, f"__{kind}__", guard, pattern, context=True)

    def of(kind: str) -> Column:
        def candidate(c: Column) -> Column:
            numbers = F.array(*[x.cast("int") for x in measured(c, kind)])
            return F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), numbers.alias("x"))

        return F.transform(f"__{kind}__", candidate)

    arrays = [of(kind) for kind in ADDED]
    return docs.withColumn(name, F.concat(*arrays)).drop(*[f"__{kind}__" for kind in ADDED])


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_documents: int = FIT_DOCUMENTS, copies: int = COPIES) -> PiiModel:
    """Trees and thresholds from examples set in prose of at most ``fit_documents`` documents, those with the smallest hashes of the key.

    A candidate is a hit if it is of the kind of a personal example and holds most of what is not a letter before it; all
    others of the example are misses.
    """
    spark = docs.sparkSession
    some = smallest(docs.filter(F.col(text).isNotNull()).select(key, text), F.col(key), fit_documents)
    prose = sorted(r["p"] for r in some.select(F.substring(text, 1, 2000).alias("p")).collect())
    table = spark.createDataFrame([(n, *e) for n, e in enumerate(examples(prose, copies))], "n long, text string, kind string, personal boolean")
    rows = candidates(table, "text").select("n", "personal", F.col("kind").alias("meant"), F.explode("candidates").alias("c")).select("n", "personal", "meant", "c.*").collect()
    rows.sort(key=lambda r: (r["n"], list(ADDED).index(r["kind"]), r["start"]))
    # one candidate of the meant kind is the one with most characters
    longest: dict[int, int] = {}
    for r in rows:
        if r["kind"] == r["meant"]:
            longest[r["n"]] = max(longest.get(r["n"], 0), r["end"] - r["start"])
    y = [r["personal"] and r["kind"] == r["meant"] and r["end"] - r["start"] == longest[r["n"]] for r in rows]
    return boosted(np.array([r["x"] for r in rows]), np.array(y), np.array([r["kind"] for r in rows]))


def kept_spans(items: Column) -> Column:
    """Spans of items (start, order, end, kind, score) sorted by start: base ones (order 0) all; an added one that meets none of them.

    Of added ones that meet one after the other the one with the higher score stays.
    """
    def step(acc: Column, s: Column) -> Column:
        base, meets = s["order"] < len(BASE), acc["end"] > s["start"]

        def state(last: Column, base_end: Column, score: Column, out: Column, end: Column) -> Column:
            return F.struct(last.alias("last"), end.alias("end"), base_end.alias("base_end"), score.alias("score"), out.alias("out"))

        flushed = F.concat(acc["out"], acc["last"])
        same = state(acc["last"], acc["base_end"], acc["score"], acc["out"], acc["end"])
        on = state(F.array(s), F.greatest(acc["base_end"], s["end"]), F.lit(1e308), F.when(meets & (acc["score"] < 1e300), acc["out"]).otherwise(flushed),
                   F.greatest(acc["base_end"], s["end"]))
        apart = state(F.array(s), acc["base_end"], s["score"], flushed, s["end"])
        instead = state(F.array(s), acc["base_end"], s["score"], acc["out"], s["end"])
        return F.when(base, on).when(acc["base_end"] > s["start"], same).when(~meets, apart).when(s["score"] > acc["score"], instead).otherwise(same)

    spans = "array<struct<start:bigint,order:int,end:bigint,kind:string,score:double>>"
    zero = F.lit(0).cast("long")
    found = folded(items, {"last": F.array().cast(spans), "end": zero, "base_end": zero, "score": F.lit(0.0)}, spans, step)
    return F.when(F.size(items) == 0, F.array().cast(spans)).otherwise(F.transform(F.array(found), lambda r: F.concat(r["out"], r["last"]))[0])


def scanned(docs: DataFrame, model: PiiModel, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with ``name``: an array of start, end (code points, end exclusive) and kind of all spans, by start, then kind as listed.

    Base matches are leftmost and do not overlap within a kind; failing ones are dropped and not tried again. Null and
    empty texts have no spans. Repeated rows stay; columns other than ``name`` are kept as they are.
    """
    own = docs.withColumn("__text__", F.col(text))
    for kind, (guard, pattern) in BASE.items():
        own = with_matches(own, "__text__", f"__{kind}__", guard, pattern, context=False)
    own = candidates(own, "__text__", "__candidates__")
    order = {k: n for n, k in enumerate([*BASE, *ADDED])}

    def item(s: Column, n: Column, kind: Column, score: Column) -> Column:
        return F.struct(s["start"].alias("start"), n.cast("int").alias("order"), s["end"].alias("end"), kind.alias("kind"), score.alias("score"))

    def base_items(kind: str) -> Column:
        return F.transform(F.filter(f"__{kind}__", lambda s: valid(kind, s["value"])), lambda s: item(s, F.lit(order[kind]), F.lit(kind), F.lit(0.0)))

    base = [base_items(kind) for kind in BASE]
    numbers = F.create_map(*[F.lit(v) for k in ADDED for v in (k, order[k])])
    limits = F.create_map(*[F.lit(v) for k, t in model.thresholds.items() for v in (k, t)])
    scored = F.transform("__candidates__", lambda c: item(c, numbers[c["kind"]], c["kind"], model.score(c["x"])))
    added = F.filter(scored, lambda s: s["score"] >= limits[s["kind"]])
    own = own.withColumn("__items__", F.sort_array(F.concat(*base, added))).withColumn("__kept__", kept_spans(F.col("__items__")))
    spans = F.transform("__kept__", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return own.withColumn(name, spans).drop("__text__", "__candidates__", "__items__", "__kept__", *[f"__{k}__" for k in BASE])


def redacted(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one with the kind of the first."""
    def cut(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    found = scanned(docs, model, text, "__spans__").withColumn("__cut__", F.aggregate("__spans__", start, cut))
    rest = F.substring(F.col(text), (F.col("__cut__.at") + 1).cast("int"), F.length(text))
    clean = F.when(F.size("__spans__") == 0, F.col(text)).otherwise(F.concat(F.array_join("__cut__.out", ""), rest))
    return found.withColumn(text, clean).select(*docs.columns)


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(spans: Column) -> list[Column]:
    """Number of base spans of each kind, the digest of their listing, and the listing of all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(list(BASE)))
    counts = [count(kind) for kind in BASE]
    return [*counts, F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(spans).alias("spans")]
