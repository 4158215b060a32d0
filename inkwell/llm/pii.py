"""Personal data and secrets: validated base patterns and gradient-boosted candidates, with SQL
functions only.

Regular expressions find matches; splitting by the same expression gives the stretches between
them, so running lengths give positions in code points without any Python on the executors.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import gbt
from inkwell.llm.common import unit_hash
from inkwell.textfn import let

KINDS = ("email", "ip", "card", "phone")
#: The kinds of added spans: those of the base patterns, and keys, passwords and access tokens.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = "A-Za-z0-9._%+-"
#: Per kind: a test that every text with a match passes, and the pattern. Patterns match what the
#: contract's do, but possessive repeats and a look at the character before keep them linear: a
#: match that could start inside a run could start at the run's head (or where the last one ended).
BASE = {
    "email": ("@", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: High-recall generators: an address spelled out, an address with odd dots, long runs of digits,
#: opaque strings of letters and digits.
CANDIDATES = {
    "email": (
        r"(?i)[\[({ ]at[\])} ]",
        rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}| at ) ?[a-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}| dot ) ?[a-z]{{2,24}}+",
    ),
    "ip": (r"[0-9](?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}", r"(?<![0-9])[0-9]{1,3}+(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}+){3}(?![0-9])"),
    "number": (r"[0-9](?:[ ().-]{0,3}[0-9]){8}", r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[ ().-]{0,3}+[0-9])++"),
    "secret": (r"[A-Za-z0-9_+/=-]{12}", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{12,}+"),
}
#: A string in an assignment to one of these names is a secret: labels for training.
_SECRET_NAME = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key|bearer|credentials?)"
#: Shapes inside a run of numbers: a phone, plain digits, a card in fours, a card of fifteen. Each is
#: looked for at every start of a number, and no string has two of them.
SHAPES = (
    r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}",
    r"[0-9]{9,19}",
    r"[0-9]{4}(?:[ ().-]{1,3}[0-9]{4}){2}[ ().-]{1,3}[0-9]{2,4}",
    r"[0-9]{4}[ ().-]{1,3}[0-9]{6}[ ().-]{1,3}[0-9]{5}",
)
_CONTEXT = 24
_SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def running(values: Column, op, kind: str = "array<int>") -> Column:
    """The running results of ``op`` (associative) over an array, each element included.

    An array that grows by an element a step copies itself each time, so blocks of about the
    root of the length are run on their own, and the results of the blocks before are put on
    top: n * sqrt(n) copies of a number, not n * n.
    """

    def plain(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.element_at(acc, -1), x))))

        return F.aggregate(part, F.array().cast(kind), step)

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))
        return let(F.transform(places, lambda i: plain(F.slice(v, i * width + 1, width))), joined)

    def joined(blocks: Column) -> Column:
        tops = plain(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(tops, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(t[i - 1], x))))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast(kind)))


def _tail(s: Column) -> Column:
    return F.substring(s, F.greatest(F.lit(1), F.length(s) - (_CONTEXT - 1)), F.lit(_CONTEXT))


def located(text: Column, pattern: str, full: Column | None = None) -> Column:
    """The matches of ``pattern``, leftmost and non-overlapping: start, end (exclusive), string, at
    most 24 characters before (of the match before and what lies between) and one after.

    ``full`` has longer strings from the same starts, each with the character after it. Everything
    is cut from the stretches between matches, never from the whole text, so that work grows with
    the text and the matches, not with their product.
    """

    def spans(gaps: Column, found: Column, ends: Column, longer: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = ends[i] - F.length(m)
            before = _tail(F.concat(F.when(i > 0, _tail(found[F.greatest(i - 1, F.lit(0))])).otherwise(""), gaps[i]))
            if full is None:
                whole, after = m, F.substring(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), 1, 1)
            else:
                more = longer[i]
                last = more.rlike("[0-9]$")
                whole = F.when(last, more).otherwise(F.substring(more, F.lit(1), F.length(more) - 1))
                after = F.when(last, "").otherwise(F.substring(more, F.length(more), F.lit(1)))
            return F.struct(start.alias("start"), (start + F.length(whole)).alias("end"), whole.alias("m"), before.alias("before"), after.alias("after"))

        return F.transform(found, one)

    def ended(gaps: Column, found: Column) -> Column:
        ends = running(F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m)), lambda a, b: a + b)
        return let(ends, lambda e: spans(gaps, found, e, found) if full is None else let(full, lambda f: spans(gaps, found, e, f)))

    return let(F.split(text, pattern, -1), lambda g: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: ended(g, m)))


def located_ahead(text: Column, shape: str) -> Column:
    """The matches of ``shape`` at every start of a number; they may overlap."""
    pattern = rf"(?<![0-9])(?=({shape}(?:[^0-9]|$)))\(?[0-9]"
    return located(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _once(spans: Column) -> Column:
    """``spans`` in order, each once."""
    return let(F.array_sort(spans), lambda v: F.filter(v, lambda x, i: (i == 0) | (x != v[F.greatest(i - 1, F.lit(0))])))


def _found(text: Column, test: str, pattern: str) -> Column:
    return F.when(text.rlike(test), located(text, pattern)).otherwise(F.array().cast(_SPAN))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(d), ""),
        lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).when(c > "4", c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2),
    )
    return F.aggregate(each, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind; those that fail are dropped, with no retry inside them."""
    return F.filter(_found(text, *BASE[kind]), lambda s: _valid(kind, s["m"]))


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


FEATURES = ("digits", "chars", "signs", "luhn", "phone_word", "card_word", "mail_word", "address_word", "other_word", "glued", "phone_shape", "brackets", "octets", "grouped", "glued_before", "plus", "letters", "mixture", "variety", "hex", "long_word", "secret_word", "assigned", "quoted", "kind")


def _features(s: Column, kind: str) -> list[Column]:
    m, d = s["m"], digits(s["m"])
    before, after = F.lower(s["before"]), s["after"]
    head = F.substring(m, 1, 128)
    return [
        F.length(d).cast("double"),
        F.length(m).cast("double"),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        _flag(luhn(d)),
        _flag(before.rlike(r"\b(?:tel|phone|telephone|mobile|cell|call|fax|whatsapp|sms)\b[^a-z]*(?:\w+ )?$")),
        _flag(before.rlike(r"\b(?:card|visa|mastercard|amex|credit|debit|pan)\b[^a-z]*(?:\w+ )?$")),
        _flag(before.rlike(r"\b(?:e-?mail|mail|contact|write|reach|address)\b[^a-z]*(?:\w+ )?$")),
        _flag(before.rlike(r"\b(?:ip|host|server|addr|address|login|from)\b[^a-z]*(?:\w+ )?$")),
        _flag(before.rlike(r"\b(?:order|invoice|isbn|ref|id|no|item|serial|version|license|page|total|sum|part|commit|sha\d*|md5)\b[^a-z]*(?:\w+ )?$")),
        _flag(after.rlike("[A-Za-z0-9_]")),
        _flag(m.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")),
        _flag(m.rlike(r"(?i)[\[({](?:at|dot|\.)[\])}]| dot ")),
        _flag(F.regexp_replace(m, r"[^0-9.]", "").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        _flag(m.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}$")),
        _flag(before.rlike("[a-z0-9.-]$")),
        _flag(before.rlike(r"\+[0-9]? ?$")),
        F.length(F.regexp_replace(head, "[^A-Za-z]", "")).cast("double"),
        F.regexp_count(head, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])")) / F.length(head),
        F.size(F.array_distinct(F.split(head, ""))) / F.length(head),
        _flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        _flag(m.rlike("[A-Za-z]{8}")),
        _flag(before.rlike(rf"{_SECRET_NAME}\W{{0,5}}$")),
        _flag(before.rlike(r"""[=:] ?["']?$""")),
        _flag(before.rlike(r"""["'`]$""")),
        F.lit(float(list(CANDIDATES).index(kind))),
    ]


def _proposal(kind: str):
    def one(s: Column) -> Column:
        number = F.when(F.length(digits(s["m"])) >= 13, KINDS.index("card") + 1).otherwise(KINDS.index("phone") + 1)
        own = F.lit(ALL_KINDS.index(kind) + 1) if kind in ALL_KINDS else number
        return F.struct(s["start"].alias("start"), own.alias("kind"), s["end"].alias("end"), F.array(*_features(s, kind)).alias("x"))

    return one


def candidates(text: Column) -> Column:
    """Proposed spans of all generators with their features; they may overlap, each comes once."""
    parts = []
    for kind, (test, pattern) in CANDIDATES.items():
        spans = located(text, pattern)
        if kind == "number":  # a run joins neighbours, so the shapes in it are proposed too, from runs of any length
            fits = F.filter(spans, lambda s: F.length(digits(s["m"])).between(9, 19))
            spans = _once(F.concat(fits, *[located_ahead(text, shape) for shape in SHAPES]))
        if kind == "secret":
            spans = F.filter(spans, lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]"))
        spans = F.when(text.rlike(test), spans).otherwise(F.array().cast(_SPAN))
        parts.append(F.transform(spans, _proposal(kind)))
    return F.concat(*parts)


def _examples(n: int, seed: int) -> list[tuple[int, str, int]]:
    """Sentences with one candidate each, made by rule: (number, text, whether it is personal)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 9)))
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digit(14)
        odd = sum(int(c) * 2 - 9 * (int(c) > 4) for c in body[::2]) + sum(int(c) for c in body[1::2])
        return body + str(-odd % 10)

    def phone() -> str:
        return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(digit(3), digit(3), digit(4))

    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def opaque() -> str:
        kind = r.randrange(5)
        if kind < 2:
            return some("0123456789abcdef", r.choice([24, 32, 40, 48, 64])) if kind else some("0123456789ABCDEF", r.choice([32, 40]))
        if kind == 2:
            return some(lower, r.randint(2, 4)) + r.choice("_-") + some(lower + upper + "0123456789", r.randint(20, 40))
        return some(lower + upper + "0123456789" + "+/" * (kind == 3), r.randint(16, 60)) + r.choice(["", "", "=", "=="]) * (kind == 3)

    names = ["token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "auth_key", "client_secret", "private_key", "bearer", "TOKEN", "API_KEY", "Password"]
    quote = lambda v: r.choice(['"{}"', "'{}'", "{}", '"{}"']).format(v)
    four = lambda c, s: s.join(c[i : i + 4] for i in range(0, 16, 4))
    wrong = lambda c: c[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10)
    octets = lambda s: s.join(str(r.randint(1, 255)) for _ in range(4))
    yes = [
        lambda: f"{r.choice(['call', 'tel', 'phone', 'mobile', 'fax'])}{r.choice([' ', ': ', ' me ', ' us '])}{phone()}",
        lambda: phone(),
        lambda: f"{r.choice(['mail', 'email', 'contact', 'write'])} {word()}{r.choice(['(at)', ' (at) ', ' [at] ', '[at]', ' at '])}{word()}{r.choice([' dot ', ' [dot] ', '(dot)', '[dot]'])}{r.choice(['com', 'org', 'net', 'de'])}",
        lambda: f"{word()}{r.choice(['(at)', ' (at) ', ' [at] '])}{word()}{r.choice(['.', ' dot ', '[dot]'])}{r.choice(['com', 'org', 'net', 'fr'])}",
        lambda: f"{r.choice(['ip', 'host', 'server', ''])} {octets(r.choice(['[.]', '(.)']))}",
        *[lambda: f"{r.choice(['card', 'visa', 'credit', 'debit', word(), word()])} {four(card(), r.choice(['.', '  ', ' - ', '. ', '.']))}"] * 2,
        *[lambda: f"{r.choice(names)}{r.choice([' = ', '=', ': ', ':', ' := '])}{quote(opaque())}"] * 2,
    ]
    no = [
        lambda: f"{r.choice(['order', 'invoice', 'ref', 'serial', 'id', 'item', ''])} {digit(r.randint(9, 19))}",
        lambda: f"{word()} {digit(16)}",
        lambda: f"{word()} at {word()}. {word()}",
        lambda: f"{word()} at {word()} dot {word()}",
        lambda: f"{r.choice(['isbn', 'part', 'no', 'total', 'version', ''])} {digit(3)}-{digit(1)}-{digit(2)}-{digit(6)}-{digit(1)}",
        lambda: f"{digit(4)}-{digit(2)}-{digit(2)} {digit(2)}.{digit(2)}.{digit(2)}",
        lambda: f"{word()} {' '.join(digit(r.randint(1, 5)) for _ in range(6))}",
        *[lambda: f"{word()} {digit(16)} {card()}"] * 2,  # a plain number that base leaves is part of a longer run
        *[lambda: f"{r.choice(['card', 'ref', word()])} {four(wrong(card()), r.choice(['.', '  ', ' - ', '. ', '.']))}"] * 2,
        lambda: f"{r.choice(['ip', 'host', word()])} {r.choice(['[.]', '(.)']).join(str(r.randint(1, 255) if r.random() < 0.3 else r.randint(256, 999)) for _ in range(3))}[.]{r.randint(256, 999)}",
        lambda: f"{word()} {'-'.join(digit(k) for k in r.choice([(2, 4, 2, 4), (4, 2, 4), (3, 4, 3), (5, 5), (4, 3, 3), (2, 3, 4, 1)]))}",
        lambda: f"{word()} {octets('(.)').replace('(.)', '[.]', 3)}{digit(2)}x" if r.random() < 0.2 else f"version {digit(2)}(.){digit(3)}(.)9{digit(2)}(.){digit(2)}",
    ]
    no += [
        lambda: f"{r.choice(['commit', 'sha1', 'sha256:', 'md5', 'at', 'digest', 'id:', 'etag =', 'uuid'])} {quote(some('0123456789abcdef', r.choice([32, 40, 64])))}",
        lambda: f"{word()}-{word()}-{word()}-{digit(r.randint(1, 4))}-{word()}",
        lambda: f"{word()}/{word()}/{digit(4)}/{digit(2)}/{word()}-{word()}",
        lambda: f"{r.choice(['name', 'title', 'file', 'class', 'src'])} = {quote(word() + '_' + word() + word() + digit(r.randint(1, 3)))}",
        lambda: f"{r.choice(['token', 'key', 'password'])} {r.choice(['of', 'is', 'for', 'was'])} {word()}{word()}{word()}{digit(1)}",
        lambda: f"{word()}{word()}{word()}{digit(r.randint(1, 2))}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        middle = r.choice(yes if label else no)()
        out.append((i, f"{word()} {word()} {middle}{r.choice(['.', ' ', ', '])}{word()}", label))
    return out


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _all_base(text: Column) -> Column:
    place = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k + 1).alias("kind"), s["end"].alias("end"))
    return F.concat(*[F.transform(base_spans(text, kind), place(k)) for k, kind in enumerate(KINDS)])


def _rewritten(r: random.Random, kind: int, m: str) -> tuple[str, int] | None:
    """A validated span of the corpus in a form that the base patterns miss (1), or as near as
    possible to it and no personal data (0)."""
    d = "".join(c for c in m if c.isdigit())
    if kind == 1:
        user, _, host = m.partition("@")
        at, dot = r.choice(["(at)", " (at) ", " [at] ", "[at]", " at "]), r.choice([" dot ", " [dot] ", "(dot)", "[dot]"])
        if r.random() < 0.5:
            return user + at + host.rsplit(".", 1)[0].replace(".", "-") + dot + host.rsplit(".", 1)[1], 1
        return f"{user} at {host.replace('.', ', ', 1)}", 0
    if kind == 2:
        return (m.replace(".", r.choice(["[.]", "(.)"])), 1) if r.random() < 0.5 else (m.replace(".", "[.]", 3) + "9" * 3, 0)
    if kind == 3 and len(d) == 16:
        groups = [d[i : i + 4] for i in range(0, 16, 4)]
        if r.random() < 0.5:
            return r.choice([".", "  ", " - ", ". "]).join(groups), 1
        wrong = d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10)
        return r.choice([wrong, wrong[:4] + "." + wrong[4:8] + "." + wrong[8:12] + "." + wrong[12:]]), 0
    if kind == 4 and len(d) >= 10:
        own = d[-10:]
        if r.random() < 0.5:
            return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(own[:3], own[3:6], own[6:]), 1
        return r.choice([own, f"{own[:2]}-{own[2:6]}-{own[6:]}-{own[:3]}", f"{own[:4]}-{own[4:6]}-{own[6:8]} {own[8:]}.30.10"]), 0
    return None


def _from_corpus(docs: DataFrame, id_col: str, text_col: str, rows: int, spans: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training material of a bounded sample of ``docs``: about ``rows`` documents by their id's
    hash, and of them at most ``spans`` of each: candidates (``h``, ``kind``, ``x``, ``label``: whether
    base or an assignment to a secret's name vouches for them) and base spans with the text around
    (``h``, ``kind``, ``before``, ``m``, ``after``)."""
    share = rows / max(1, docs.count())
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.where((unit_hash(seed, F.col("id")) < min(1.0, share)) & F.col("id").isNotNull() & F.col("text").rlike("[0-9]")).select("text")
    text = F.col("text")
    each = picked.withColumn("base", _all_base(text)).withColumn("c", candidates(text))
    has = lambda c, name, least=1: F.element_at(c["x"], FEATURES.index(name) + 1) >= least

    def label(c: Column) -> Column:
        secret = c["kind"] == len(ALL_KINDS)
        vouched = F.exists("base", lambda b: _overlaps(b, c) & (b["kind"] == c["kind"])) | (secret & has(c, "secret_word") & has(c, "assigned"))
        number = has(c, "phone_shape") | (has(c, "luhn") & has(c, "digits", 13))
        unknown = F.when(secret, has(c, "secret_word") | has(c, "assigned")).otherwise(number | has(c, "brackets") | has(c, "octets"))
        return F.when(vouched, 1).when(~unknown, 0)  # what has a right form but nothing to vouch for it teaches nothing

    told = each.select(F.explode(F.transform("c", lambda c: F.struct(c["kind"].alias("kind"), c["x"].alias("x"), label(c).alias("label")))).alias("t"), F.xxhash64(F.lit(seed), text).alias("h"))
    told = told.select(F.xxhash64("h", "t").alias("h"), "t.*").where("label is not null").orderBy("h", "kind", "x").limit(spans)
    around = lambda s: F.struct(
        s["kind"].alias("kind"), F.substring(text, F.greatest(F.lit(1), s["start"] - 39), F.least(F.lit(40), s["start"])).alias("before"),
        F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("m"), F.substring(text, s["end"] + 1, F.lit(12)).alias("after"),
    )
    near = each.select(F.explode(F.transform("base", around)).alias("s")).select(F.xxhash64(F.lit(seed), "s").alias("h"), "s.*").where(F.length("m") < 100)
    return told, near.orderBy("h", "before", "m").limit(spans)


_models: dict = {}


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = 3000, rows: int = 10_000, spans: int = 3000, seed: int = 11, precision: float = 0.99
) -> tuple[list, list[float]]:
    """Trees and a threshold for each kind.

    They learn from three kinds of candidates, all with the features of the SQL that scores:
    those of about ``rows`` documents (at most ``spans``), which base patterns or an assignment to a
    secret's name vouch for, or whose form rules them out; validated spans of those documents (at most ``spans``), rewritten
    in their own surroundings as people disguise them, or into near misses; and ``examples``
    sentences made by rule, for what a corpus doesn't hold. The bounds hold for fitting only. A
    third is held out, and a kind's threshold is the lowest score at which ``precision`` of its
    held-out candidates from there on are personal, but never one at which it is likelier that a
    candidate is not. A table without any span leaves the examples.
    """
    spark = docs.sparkSession
    told, near = _from_corpus(docs, id_col, text_col, rows, spans, seed)
    told, near = told.collect(), near.collect()
    r = random.Random(seed)
    made = [(i, text, 0, len(text), label) for i, text, label in _examples(examples, seed)]
    for row in near:
        if (new := _rewritten(r, row["kind"], row["m"])) is not None:
            made.append((len(made), f"{row['before']}{new[0]}{row['after']}", len(row["before"]), len(row["before"]) + len(new[0]), new[1]))
    key = (hash(tuple(map(repr, told))), hash(tuple(made)), precision)
    if key not in _models:
        frame = spark.createDataFrame(made, "n int, text string, start int, end int, label int")
        c = F.filter(candidates(F.col("text")), lambda c: (c["start"] < F.col("end")) & (F.col("start") < c["end"]))
        exact = lambda c: (c["start"] == F.col("start")) & (c["end"] == F.col("end"))
        # of a rewritten span only candidates that are it count, if there are any
        c = F.when((F.col("n") >= examples) & F.exists(c, exact), F.filter(c, exact)).otherwise(c)
        scored = frame.select("n", "label", F.explode(c).alias("c")).select("n", "label", "c.kind", "c.x").collect()
        data = [(x["n"], x["kind"], x["x"], x["label"]) for x in scored] + [(x["h"], x["kind"], x["x"], x["label"]) for x in told]
        data.sort()
        x, y = np.array([d[2] for d in data]), np.array([d[3] for d in data], dtype=float)
        kind, held = np.array([d[1] for d in data]), np.array([d[0] // 2 % 3 == 0 for d in data])
        trees = gbt.train(x[~held], y[~held])
        score = gbt.log_odds(trees, x)
        of = lambda k: held & (kind == k + 1)
        cuts = [max(0.0, gbt.threshold_for_precision(score[of(k)], y[of(k)], precision)) for k in range(len(ALL_KINDS))]
        _models.clear()
        _models[key] = trees, cuts
    return _models[key]


def _kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ALL_KINDS)), kind)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", _kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


_PLACE = "array<struct<start:int,kind:int,end:int>>"


def _chosen(spans: Column) -> Column:
    """Of scored spans (``score`` null: a base span) those that overlap no base span and no
    added one of a better score, the first on a tie.

    Sorted by start, spans fall into stretches that don't touch; only spans of one stretch are
    compared with each other.
    """
    ahead = lambda o, a: o["score"].isNull() | (o["score"] > a["score"]) | (
        (o["score"] == a["score"]) & ((o["start"] < a["start"]) | ((o["start"] == a["start"]) & (o["kind"] < a["kind"])))
    )
    best = lambda part: F.filter(part, lambda a: a["score"].isNotNull() & ~F.exists(part, lambda o: _overlaps(o, a) & ahead(o, a)))

    def parted(v: Column) -> Column:
        reach = running(F.transform(v, lambda x: x["end"]), F.greatest)
        first = lambda far: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (v[i]["start"] >= far[F.greatest(i - 1, F.lit(0))]))
        parts = lambda at: F.flatten(F.transform(at, lambda x, j: best(F.slice(v, x + 1, F.when(j + 1 < F.size(at), at[F.least(j + 1, F.size(at) - 1)]).otherwise(F.size(v)) - x))))
        return let(reach, lambda far: let(first(far), parts))

    return let(F.array_sort(spans), lambda v: F.when(F.size(v) > 0, parted(v)).otherwise(F.filter(v, lambda x: F.lit(False))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """``doc_id``, ``text`` and ``base``, ``added``: arrays of (start, kind, end) in code points.

    Base spans are the validated patterns of each kind, leftmost and non-overlapping. Boosted
    trees add the candidates over their kind's threshold that overlap no base span; of added
    spans that overlap each other the best score stays, the first on a tie. Null and empty texts
    have none; repeated rows repeat; only the id and text columns are read; an empty table stays
    empty. After the fit a narrow map: each generator has a test that passes every text with a
    match, and work in a text grows little faster than its matches.
    """
    trees, cuts = fit(docs, id_col, text_col, **fit_options)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.when(text.rlike("[0-9@]"), _all_base(text)).otherwise(F.array().cast(_PLACE))

    def scored(c: Column) -> Column:
        score = gbt.log_odds_column(trees, [F.element_at(c["x"], i + 1) for i in range(len(FEATURES))])
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), score.alias("score"))

    limit = F.array(*[F.lit(float(min(c, 1e300))) for c in cuts])
    found = src.withColumn("base", base).withColumn("_s", F.transform(candidates(text), scored))
    found = found.withColumn("_s", F.filter("_s", lambda a: a["score"] > F.element_at(limit, a["kind"])))
    known = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("double").alias("score")))
    chosen = F.when(F.size("_s") > 0, _chosen(F.concat("_s", known))).otherwise(F.col("_s"))
    added = F.transform(chosen, lambda a: F.struct(a["start"].alias("start"), a["kind"].alias("kind"), a["end"].alias("end")))
    return found.withColumn("added", added).drop("_s")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the SHA-256 of their list, all spans as one string, how many of
    them the trees added, and whether there is any."""
    of = lambda k: F.filter("base", lambda s: s["kind"] == k + 1)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size(F.concat("base", "added")) > 0).alias("private"))


def redact(found: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``found`` with ``redacted``: the text with every span replaced by its kind's mask; of spans
    that overlap, the one that starts first is written and the others are cut away with it."""
    spans = F.array_sort(F.concat("base", "added"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.element_at(F.array(*[F.lit(mask.format(k)) for k in ALL_KINDS]), s["kind"])
        head = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], head, label)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("redacted", done)
