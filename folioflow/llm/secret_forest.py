"""Secret scans: candidates by shape, false positives removed by a random forest, with DataFrame expressions only.

Candidates are all values of a word: those that follow a key's name or a URL's user (of any length and kind but quotes, brackets
and & , ; unless they stand in quotes), also if the name is the word before ("password: x", "the password is x", "Bearer x") or a private key's heading is, and
others of [A-Za-z0-9+/_.~-] between delimiters that have eight characters and a digit, or sixteen. A value's features are its length, its transitions between
kinds of characters, its digits and distinct characters, how much of it word parts and the corpus' own frequent words cover, what makes it a path,
a name in code or a mask, and what the neighbouring words say. The forest is trained on labelled findings (values made by rule, and the candidates of labelled
lines: settings, code, templates and prose with and without secrets; or a table of findings, of which
the LABELLED rows of least hash are read) and becomes one expression of nested conditions, so that scanning is a projection of each row.

Defined results: null and empty texts have no candidates and score 0; rows that repeat are scanned alike; an empty table gives no rows; extra
columns pass through, and clashing names get underscores. A text of any length is one row of linear work; findings come in the order of their words, and words
of equal document counts enter the dictionary by code point.
"""

from __future__ import annotations

import random
import re
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Findings that a forest is trained on, at most.
LABELLED = 20_000
TREES, DEPTH, LEAST_LEAF = 15, 8, 5
#: A value without a name before it is a candidate from LEAST characters on if it has a digit, else from LONG on.
LEAST, LONG = 8, 16
#: Size of the corpus' dictionary: its most frequent words, each in so many documents and in one of so many.
DICTIONARY_WORDS, LEAST_DOCUMENTS, ONE_OF = 10_000, 5, 2_000

#: Shapes of words, of values and of their neighbours.
VALUE = r"(?:^|[=:\"'`(\[{<,;&@?#|])([A-Za-z0-9+/_.~\-]{8,}=*)(?=[\"'`)\]}>,;.!?&@:#|<\\]|$)"
#: A name's value, to the closing quote or a delimiter; the password of a URL's user; and a whole word after a name with = or :.
_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)(?:[_-]\w+|\d+)?"
_TAIL = r"((?<=\")[^\"]+(?=\")|(?<=')[^']+(?=')|[$%]?[<{(\[]{1,2}[^\s\"'`]+|[^\s\"'`&,;<>(){}\[\]\\]+)"
NAMED = rf"(?i){_NAME}\\?[\"'`]?[=:]\\?[\"'`]?{_TAIL}[(\[{{<]?"
USER = r"://[^/\s:@\"']*:([^/\s\"']+)@"
#: A value in prose, and what stands before a private key's first line.
IS_NAMED = r"(?i)(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|credentials?)\s(?:is|was|are)$"
VERBS, BEARER = ("is", "was", "are"), ("Bearer", "bearer")
PEM, PEM_HEAD = r"^KEY-----(?:\\[rn])+([A-Za-z0-9+/]{16,}=*)", r"PRIVATE(?:\sKEY-----)?$"
AFTER_NAME = rf"(?i){_NAME}[\"']?(?:\s*[=:]|[=:][\"'])$"
KEYED = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)[\"']?\s*[=:]?[\"']?$"
KEYED_IN = r"(?i)^[\"'`(]*[\w.-]*(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)[\w-]*[\"']?[=:]"
HARMLESS = r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|test|commit|sha\d*|md5|hash|checksum|digest|uuid|guid|version|build|rev|isbn|phone|tel|order|ticket|invoice)[=:]?$"
KNOWN = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{30,}$|^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
TRANSITION = r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])|[A-Za-z0-9](?=[^A-Za-z0-9])"
#: What stands for a value in code (types and constants, members, names, references), and masks. Repeated groups are possessive: others recurse once a repeat.
TYPES = r"(?i)^[\[(]?(str|string|bytes|bool|boolean|int|integer|number|text|object|any|char|varchar|none|null|nil|true|false|undefined|void|optional|required|default|empty|unknown|disabled|enabled)\b[\[\](){}<>?!|.,;=]*[\w\[\]<>]*$"
MEMBER = r"^[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)++[.,;]?$"
NAME = r"^([A-Z]+(?:_[A-Z]+)++|[a-z]+(?:_[a-z]+)++|_[a-z_]+)[.,;]?$"
REFERENCE = r"^[\"']?([$%@<{\[(]|!Ref|env:|vault:|secrets?\.)"
MASK = r"^[\"']?(.)\1{2,}[\"',;.]*$|^[*x.#_\-\u2022]{3,}$|(?i)redacted|masked|\*{3,}|^\.\.\."
#: Frequent words and word parts of four languages, and of file and variable names.
WORDS = (
    "able about access after and array aux back base block body build button byte cache call chapter char check class client close code color column commit config content copy count create data date default delete des down ein "
    "end ene entry error eur event example export field file filter find form format frame from func get group handle hash head heit height host http image import index info ing init input insert ion item keit key label land last "
    "layer layout length level lich line link list load local lock log main manager map match max ment message method min mode model module name next node none null number object offset open order out page panel param parent "
    "parse part path plus point port print process property query que queue range read record ref remove render request reset result return root row run sample save schema screen section select send server set sich size source "
    "src stack start state stop store string style sum table tag target task temp text that this time tion title top tree type und unit update url user value vector version view web with word work wrap write www year your zone"
).split()
DICTIONARY = f"(?:{'|'.join(sorted(WORDS, key=lambda w: (-len(w), w)))})"

def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)


def _at(words: Column, i: Column) -> Column:
    return F.when(i >= 0, F.coalesce(F.get(words, i), F.lit(""))).otherwise(F.lit(""))


FEATURES = ["length", "transitions", "digits", "distinct", "covered", "hex", "path", "keyed", "harmless", "known", "upper", "worded", "code", "reference", "mask", "marks", "prose"]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_WORDS) -> list[str]:
    """The corpus' most frequent words of letters a to z that stand alone, by the number of documents that hold them: size words at most reach the driver."""
    own = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w.rlike("^[a-z]{3,24}[.,;:!?]?$"))
    alone = F.array_distinct(F.transform(own, lambda w: F.rtrim(w, F.lit(".,;:!?"))))
    n = docs.count()
    counted = docs.select(F.explode(alone).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(LEAST_DOCUMENTS, n // ONE_OF))
    return sorted(r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(size).collect())


def features(value: Column, word: Column, before: Column, after: Column, words: list[str] | None = None) -> list[Column]:
    """The numbers that the forest splits at, in the order of FEATURES. before: the two words before, after: the next; words: a dictionary."""
    n = F.length(value).cast("double")
    part = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double") / n
    is_so = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rest = F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")).cast("double")
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{3,}"), F.lit(0))
    known = sorted({*WORDS, *(words or ())})
    return [
        n,
        part(TRANSITION),
        part("[0-9]"),
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        1.0 - rest / n,
        is_so(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        F.regexp_count(word, F.lit(r"[/\\]|://|\.[a-z]{2,4}\b|@")).cast("double"),
        is_so(word.rlike(KEYED_IN)) + is_so(before.rlike(KEYED)) + is_so(before.rlike(KEYED.replace("$", r"\s+[=:]\s*$"))) + is_so(before.rlike(PEM_HEAD)),
        is_so(before.rlike(HARMLESS)) + is_so(word.rlike(r"(?i)example|x{4,}|0{6,}|placeholder|changeme|your_") | value.rlike("^0?1234567")) + is_so(after.rlike(r"(?i)^(commit|checksum|example)")),
        is_so(value.rlike(KNOWN)),
        part("[A-Z]"),
        F.aggregate(runs, F.lit(0.0), lambda a, w: a + F.when(w.isin(known), F.length(w).cast("double")).otherwise(F.lit(0.0))) / n,
        is_so(value.rlike(TYPES)) + is_so(value.rlike(MEMBER)) + is_so(value.rlike(NAME)) + is_so(word.rlike(r"[(\[{<]$")),
        is_so(value.rlike(REFERENCE)),
        is_so(value.rlike(MASK)),
        part("[^A-Za-z0-9]"),
        is_so(before.rlike(IS_NAMED)),
    ]


def findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings made by rule: value, word, before, after, label (1: a secret). Half of them are false positives."""
    rng = random.Random(seed)
    text = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    mixed, hexa, upper = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
    words = "the of und der que les chapter section image value number report order page from with para eine".split()
    syllables = "an er on re en ti ha ou st nd ion ment que lich heit aux ci do".split()
    plain = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(4, 9)))
    keys = ["password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth", "client_secret"]
    out = []
    for _ in range(n // 2):
        kind, word, before, after = rng.randrange(8), "", f"{rng.choice(words)} {rng.choice(words)}", rng.choice(words)
        if kind == 0:
            value = word = rng.choice(["AKIA", "ASIA"]) + text(upper, 16, 16)
        elif kind == 1:
            value = text(rng.choice([hexa, mixed]), 10, 48) + rng.choice(string.digits)
            word = f"{rng.choice(keys)}{rng.choice('=:')}{rng.choice(['', chr(34)])}{value}"
        elif kind == 2:
            value, before = text(rng.choice([hexa, mixed]), 16, 48) + rng.choice(string.digits), f"{rng.choice(keys)} {rng.choice('=:')}"
            word = f'"{value}"'
        elif kind == 3:
            value, before = text(mixed, 20, 44) + rng.choice(string.digits), f"{rng.choice(words)} {rng.choice(['Bearer', 'token:', 'secret:', 'password:'])}"
            word = value
        elif kind == 4:
            value = word = rng.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "AIza"]) + text(mixed, 32, 40)
        elif kind == 5:
            value = word = text(mixed + "+/", 36, 60) + rng.choice(string.digits)
        else:
            value = rng.choice([text(mixed + "$!%*^@#?", 6, 20), plain(), plain() + text("$!%*^@#?", 1, 2) + text(string.digits, 1, 4)])
            word = f"{rng.choice(keys)}{rng.choice('=:')}{rng.choice(['', chr(34)])}{value}"
            if kind == 7:
                word, before = value, f"{rng.choice(words)} {rng.choice(keys)}{rng.choice('=:')}"
        out.append((value, word, before, after, 1))
    for _ in range(n - n // 2):
        kind, before, after = rng.randrange(9), f"{rng.choice(words)} {rng.choice(words)}", rng.choice(words)
        if kind == 0:
            value, before = text(hexa, 32, 40), f"{rng.choice(words)} {rng.choice(['commit', 'sha256', 'md5', 'checksum', 'hash:'])}"
        elif kind == 1:
            value = str(uuid.UUID(int=rng.getrandbits(128)))
        elif kind == 2:
            value = f"{plain()}/{plain()}{rng.randint(1, 99)}.{rng.choice(['html', 'png', 'txt'])}"
        elif kind == 3:
            value = f"{plain()}{rng.randint(0, 2030)}"
        elif kind == 4:
            value = text(string.digits, 10, 16)
        elif kind == 5:
            value = f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T10.15"
        elif kind == 6:
            value = rng.choice(["EXAMPLE", "your_token_", "changeme", "xxxxxxxx"]) + text("0x1", 4, 12) + "1"
            before = f"{rng.choice(keys)} {rng.choice('=:')}"
        elif kind == 7:
            value = f"{plain()}-{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"
        else:
            value = f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        out.append((value, value, before, after, 0))
    return out


#: Labelled lines. {v} is a secret, {p} one that may be a passphrase of letters, {k} one with its maker's prefix; of the harmless
#: ones {w} is a word, {n} a number, {h} a hash, {f} a file.
SECRET_LINES = """
password={p} | DB_PASSWORD="{p}" | db_password: '{p}' | export API_KEY={v} | "token": "{v}", | {"secret":"{p}","id":{n}} | Authorization: Bearer {v} | postgres://{w}:{p}@db:5432/app
https://{w}.org/x?token={v}&page={n} | the password is {v} | password was {v}, then {w} | your password: {p} | pwd={v}; user={w} | auth_token = "{v}" | secret = {v} | aws_secret_access_key = {v}
client_secret={v} | passwd: {p} | "password":"{p}" | set token={v} here | ({w} api_key='{v}') | use {k} to {w} | key {k} of {w} | "{k}" | {w}={k} | https://{w}.org/{w}?x={k} | {w} {v}{v} {w}
-----BEGIN PRIVATE KEY-----\n{v}{v}{v}\n-----END PRIVATE KEY----- | -----BEGIN OPENSSH PRIVATE KEY----- {v}{v} | access_key: "{v}" | --password={p} | credentials={v} | secret: {p}
"""
CLEAN_LINES = """
password: string | password: str, | token: Option<String>, | secret: null | token=None | password=True | auth=false | password: required | token: str = "" | password VARCHAR | secret=undefined
password=os.environ["DB_PASSWORD"] | token = os.getenv("TOKEN") | secret=process.env.{w} | api_key=${API_KEY} | PASSWORD=$DB_PASS | secret: {{ .Values.{w} }} | password=%(password)s | token=%s
password=getpass.getpass() | token = get_token({w}) | token=self.{w} | secret = config.{w}_key | token=request.headers.get("X") | password=user.password | auth=HTTPBasicAuth({w}, | token=generateToken( | secret=load_{w}()
password=<password> | token=YOUR_TOKEN | api_key=xxxxxxxxxxxx | password=******** | secret=changeme | password=[REDACTED] | password: your_password_here | token = "..." | api_key: <{w}> | password=password | token={w}_token
password is {w} | the token is {w} | token: a {w} of text | secret: how to {w} | the password was {w} | the secret is {w} | tokens are {w}. | password: {w} {w} | his secret: {w}, {w} | my secret is {w}! | the password is too {w}
token=/var/run/{w}.txt | private_key=~/.ssh/id_rsa | secret: path/to/{w}.json | auth={w}.{w} | password=/etc/{w}/{f} | key_file={f} | token={n} | max_token={n} | auth: {n} | token:{n} | password=a | secret:x
order {n}{n}{n} | commit {h} of {w} | sha256:{h} | md5 = {h} | checksum {h}{h} | {f} {w} | see https://{w}.org/{w}/{f} | version {n}.{n}.{n}-{w} | {w}{n}@mail.{w}.org | {w}-{w}-{w}-{w}-{w} | {w}{w}{w}{w} | {w}/{w}/{w}/{w}{n}
call +{n}{n}{n} | {n}-{n}-{n}T{n}:{n} | id={n}{n}{n}{n} | uuid {h} | build {h} | /usr/share/{w}/{f} | {w}_{w}_{w}_{n} | {W}{W}{W}{n} | {W}{W}{W}{W}Exception | {w}.{w}.{w}.{W}{n} | ISBN {n}{n}{n}{n}
-----BEGIN CERTIFICATE----- {w} | -----BEGIN PUBLIC KEY----- {w}{w} | the bearer of {w} | Authorization: Bearer token | Bearer $TOKEN | Bearer <{w}> | bearer {w} | password=test | token=example | secret=dummy{n} | password=user_{w} | pass:{w} | auth:{w} | token={w} | "token": "{w}"
"""


def lines(each: int = 60, seed: int = 12) -> list[tuple[str, list[str]]]:
    """Labelled lines: the text and the secrets in it. Each pattern is filled anew so many times."""
    rng = random.Random(seed)
    text = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    mixed, hexa, marks = string.ascii_letters + string.digits, "0123456789abcdef", "!$%*^@#?+-_"
    syllables = "an er on re en ti ha ou st nd ion ment que lich heit aux ci do cor horse rect blue run".split()
    letters = lambda lo, hi: "".join(rng.choice(syllables) for _ in range(rng.randint(lo, hi)))
    word = lambda: rng.choice([w for w in WORDS if len(w) > 3])

    def secret(passphrase: bool) -> str:
        kind = rng.randrange(7 if passphrase else 5)
        if kind == 0:
            return text(hexa, 12, 40) + rng.choice("0123456789a")
        if kind == 1:
            return text(mixed, 10, 44)
        if kind == 2:
            return text(mixed + marks, 8, 20) + rng.choice(string.digits)
        if kind == 3:
            return text(string.ascii_letters, 4, 8) + text(string.digits, 2, 4) + text("!$%*^#?", 0, 2)
        if kind == 4:
            return letters(1, 3).title().replace("o", "0").replace("e", "3") + rng.choice(marks) + text(mixed, 1, 4) + rng.choice(string.digits)
        return letters(5, 8) if kind == 5 else letters(2, 4) + text(string.digits, 1, 4)

    known = lambda: rng.choice(["AKIA" + text(string.ascii_uppercase + string.digits, 16, 16), rng.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "AIza"]) + text(mixed, 32, 40)])
    slots = {"n": lambda: str(rng.randint(1, 9999)), "h": lambda: text(hexa, 32, 40), "w": word, "W": lambda: word().title(), "f": lambda: f"{word()}{rng.randint(1, 99)}.{rng.choice(['html', 'png', 'txt', 'pem'])}"}
    out = []
    for block, times in ((SECRET_LINES, 2 * each), (CLEAN_LINES, each)):
        for pattern in (p.strip() for line in block.strip().splitlines() for p in line.split(" | ")):
            for _ in range(times):
                parts, secrets, run = [], [], ""
                for part in re.split(r"(\{[vpknhwWf]\})", pattern.replace("\\n", "\n")):
                    kind = part[1:-1] if re.fullmatch(r"\{[vpknhwWf]\}", part) else ""
                    own = "" if not part else slots[kind]() if kind in slots else secret(kind == "p") if kind in ("v", "p") and kind else known() if kind == "k" else part
                    if kind == "v" and "{v}{v}" in pattern:
                        own = text(mixed + "+/", 20, 30)
                    if part and kind and kind in "vpk":
                        run += own
                    elif part and run:
                        secrets.append(run)
                        run = ""
                    parts.append(own)
                out.append((f"{rng.choice([word(), '#', ''])} {''.join(parts)} {word()}", secrets + ([run] if run else [])))
    return out


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list:
    """A forest: trees of (feature, threshold, left, right) with the share of secrets at the leaves."""
    rng = np.random.default_rng(seed)
    some = max(2, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, left: int):
        share = float(y[rows].mean())
        if not left or share in (0.0, 1.0) or len(rows) < 2 * LEAST_LEAF:
            return share
        best = (share * (1 - share) - 1e-9, None)
        for f in rng.choice(x.shape[1], some, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.arange(LEAST_LEAF, len(rows) - LEAST_LEAF + 1)
            at = at[v[at - 1] < v[at]]
            if not len(at):
                continue
            p, q = ones[at - 1] / at, (ones[-1] - ones[at - 1]) / (len(rows) - at)
            gini = (at * p * (1 - p) + (len(rows) - at) * q * (1 - q)) / len(rows)
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (gini[k], (int(f), float((v[at[k] - 1] + v[at[k]]) / 2)))
        if best[1] is None:
            return share
        f, threshold = best[1]
        low = x[rows, f] <= threshold
        return (f, threshold, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return [grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)]


def forest(spark: SparkSession, labelled: DataFrame | None = None, limit: int = LABELLED, words: list[str] | None = None, **how) -> list:
    """The forest trained on labelled (value, word, before, after, label), or on findings() and the candidates of lines()."""
    if labelled is None:
        texts = spark.createDataFrame(lines(), "text string, secrets array<string>")
        own = _with_candidates(texts, F.col("text"), "words", "places", "candidates").select("secrets", F.explode("candidates").alias("c"))
        found = own.select("c.value", F.col("c.whole").alias("word"), "c.before", "c.after", F.array_contains("secrets", F.col("c.value")).cast("int").alias("label"))
        labelled = found.unionByName(spark.createDataFrame(findings(), "value string, word string, before string, after string, label int"))
    key = F.xxhash64("value", "word", "before", "after")
    rows = labelled.select(*features(F.col("value"), F.col("word"), F.col("before"), F.col("after"), words), F.col("label").cast("int"), key.alias("k")).orderBy("k").limit(limit).collect()
    data = np.array([tuple(r)[:-1] for r in rows], np.float64)
    return train(data[:, :-1], data[:, -1], **how)


def _vote(tree, values: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, threshold, low, high = tree
    return F.when(F.get(values, F.lit(f)) <= threshold, _vote(low, values)).otherwise(_vote(high, values))


def probability(trees: list, values: Column) -> Column:
    return sum((_vote(t, values) for t in trees), F.lit(0.0)) / len(trees)


def _with_candidates(docs: DataFrame, text: Column, words_name: str, places_name: str, name: str) -> DataFrame:
    """docs with its words, the places of those that hold candidates, and the candidates (word, value, whole, before, after)."""
    words = F.col(words_name)
    word = lambda i: F.get(words, i)
    last = lambda i: _at(words, i - 1)
    before = lambda i: F.concat_ws(" ", _at(words, i - 2), last(i))
    shaped = lambda i: (F.length(word(i)) >= LEAST) & (word(i).rlike("[0-9]") | (F.length(word(i)) >= LONG)) & word(i).rlike(VALUE)
    named = lambda i: word(i).rlike("[=:]") & (word(i).rlike(NAMED) | word(i).rlike(USER))
    headed = lambda i: ((last(i) == "KEY-----") | word(i).startswith("KEY-----\\")) & before(i).rlike(PEM_HEAD)
    after_name = lambda i: (last(i).rlike("[=:][\"']?$") & before(i).rlike(AFTER_NAME)) | (last(i).isin(*VERBS) & before(i).rlike(IS_NAMED)) | last(i).isin(*BEARER) | headed(i)
    out = docs.withColumn(words_name, _words(text))
    out = out.withColumn(places_name, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (word(i) != "") & (shaped(i) | named(i) | after_name(i))))

    def candidates(i: Column) -> Column:
        """All values of a word with what stands for it in the features: a named value its name, others the word without those."""
        every = lambda text, pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        own = lambda value, whole: F.struct(i.alias("word"), value.alias("value"), whole.alias("whole"), before(i).alias("before"), _at(words, i + 1).alias("after"))
        by_user = F.transform(every(word(i), USER), lambda v: own(v, F.concat(F.lit("password="), v)))
        left = F.regexp_replace(word(i), USER, "://,")
        by_name = F.zip_with(every(left, NAMED), every(left, NAMED, 0), own)
        left = F.regexp_replace(left, NAMED, ",")
        quoted = F.regexp_extract(word(i), r"^[\"'`]+([^\"'`]+)[\"'`]", 1)
        in_head = F.regexp_extract(word(i), PEM, 1)
        bare = F.regexp_replace(word(i), r"^[\"'`]+|[\"'`,;.]+$", "")
        whole = F.when(in_head != "", in_head).when(quoted != "", quoted).otherwise(bare)
        is_whole = after_name(i) & (F.size(by_name) == 0) & (F.size(by_user) == 0) & (whole != "")
        others = F.transform(F.filter(every(left, VALUE), lambda v: v.rlike("[0-9]") | (F.length(v) >= LONG)), lambda v: own(v, left))
        return F.when(is_whole, F.array(own(whole, word(i)))).otherwise(F.concat(by_user, by_name, others))

    return out.withColumn(name, F.flatten(F.transform(places_name, candidates)))


def scan(docs: DataFrame, text_col: str = "text", trees: list | None = None, threshold: float = 0.5, words: list[str] | None = None) -> DataFrame:
    """docs with n_candidates, findings (word: its place, value, probability) above threshold, and score (the largest probability of all candidates).

    words: the dictionary that trees was trained with; without trees it is built from docs.
    """
    if trees is None:
        words = dictionary(docs, text_col) if words is None else words
        trees = forest(docs.sparkSession, words=words)
    names = {c: fresh(c, docs.columns) for c in ("words", "places", "candidates", "n_candidates", "findings", "score")}
    out = _with_candidates(docs, F.col(text_col), names["words"], names["places"], names["candidates"])
    numbered = F.transform(F.col(names["candidates"]), lambda c: F.struct(c["word"].alias("word"), c["value"].alias("value"), F.array(*features(c["value"], c["whole"], c["before"], c["after"], words)).alias("x")))
    out = out.withColumn(names["candidates"], numbered)
    rated = F.transform(F.col(names["candidates"]), lambda c: F.struct(c["word"].alias("word"), c["value"].alias("value"), probability(trees, c["x"]).alias("probability")))
    out = out.withColumn(names["candidates"], rated)
    out = out.withColumns({
        names["n_candidates"]: F.size(names["candidates"]).cast("long"),
        names["findings"]: F.filter(F.col(names["candidates"]), lambda c: c["probability"] >= threshold),
        names["score"]: F.coalesce(F.array_max(F.transform(F.col(names["candidates"]), lambda c: c["probability"])), F.lit(0.0)),
    })
    return out.drop(names["words"], names["places"], names["candidates"])
