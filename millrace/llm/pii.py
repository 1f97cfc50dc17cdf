"""Personal information inside free text: bootstrapped contextual extraction.

One pass over the texts lists candidates by wide rules: chains of capitalised words, groups of
digits, at-signs and their spelled-out forms, numbers beside capitalised words. A candidate is
an instance (a word, the shape of a number, a domain, a street type) seen in patterns (its
neighbour word, the words before it, a street name). Seed entities then decide, and Spark
scores the graph of patterns and instances in rounds:

* names     a title makes the next word a surname; a word that stands before several known
            surnames is a given-name pattern; a word that follows several such patterns is a
            surname, also where no title ever came before it;
* numbers   a number of any length after a word for telephones or identity papers is a seed; words
            before known shapes become contexts; shapes in good contexts are taken too; short
            numbers are taken after those seed words that mostly have full numbers after them;
* emails    a domain is known by local parts made of names or by words for mail; a known
            domain is then found in spelled-out forms;
* streets   street words and words for addresses are seeds; a name with several known street words,
            in several contexts or after a word for addresses is a known street; words before
            known streets become contexts; words that follow several known names are new street
            words. A name with a known street word only is taken unless it stands after a word that
            mostly comes before other numbers and names.

Every family goes on in rounds until a round finds nothing new; sets only grow, so it ends.
A candidate is reported where its instances and patterns are accepted. Text inside JSON string
escapes is read as the text it stands for; positions refer to the text as it stands.

Defined cases: null and empty texts have no candidates; texts are read whole; repeated rows
give repeated candidates and one found row; an empty table gives empty results; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.common import cut, ship

# Words that mark seed entities.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "mlle", "sr", "sra", "srta")
PHONE_WORDS = "tel|tél|telefon|téléphone|teléfono|phone|call|call me|ring|mobile?|cell|sms|fax"
ID_WORDS = "ssn|ni no|nino|passport|passport no|ausweisnr|social security|national insurance|identity card|id card|dni"
MAIL_WORDS = r"(?:mailto|e?-?mail|contact|kontakt|write to|contactez|escriba a|author|from)"
ADDRESS_WORDS = ("address", "adresse", "anschrift", "wohnhaft", "dirección", "domicilio", "domicile", "indirizzo")
#: Words whose number is their own, and no house number.
LABELS = ("figure", "fig", "table", "section", "chapter", "question", "exercise", "equation", "step", "part", "page", "line", "version", "abbildung", "tabelle")
STREET_WORDS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "blvd", "boulevard", "court", "terrace")

_UP = "A-ZÀ-ÖØ-ÞĀ-Ž"
_TOKEN = rf"[{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*\.?"
_CHAIN = re.compile(rf"(?<![^\W_])(?<!\w[.@-]){_TOKEN}(?:,? {_TOKEN})+")
_ONE = re.compile(_TOKEN)
_NUMBER = re.compile(r"(?<![\w.,+/-])[+(]?\d+(?:(?:\) ?|[ ./-]| \()\d+)+(?: ?(?:ext\.?|x) ?\d+)?(?![\w/+])|(?<![\w.,+/-])\+\d{7,18}(?![\w/+]|\.\d)")
_CODE = re.compile(r"(?<![\w/+])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?(?:\d|[A-D])|(?=[A-Z]*\d)(?=\d*[A-Z])(?:[A-Z]?\d){4,}[A-Z]?\d*[A-Z]?)(?![\w/+])")
# a word for telephones or papers, and what follows it
_SEED = re.compile(
    rf"(?<!\w)(?i:(?P<phone>{PHONE_WORDS})|(?P<id>{ID_WORDS}))(?i:\W{{0,3}}(?:no|nr|number|nummer|num)\b)?[^\w\n\v+(]{{0,6}}(?=[+(]?[A-Z]{{0,3}} ?\d)"
)
# where such a word begins, in small letters: much faster to look for
_SEED_WORD = re.compile(rf"\b(?:{PHONE_WORDS}|{ID_WORDS})")
_FOLLOWS = {
    "phone": re.compile(r"[+(]?\d+(?:(?:\) ?|[ ./-]| \()\d+)*(?: ?(?:ext\.?|x) ?\d+)?(?!\w|[.,]\d)"),
    "id_number": re.compile(r"[A-Z]{0,3} ?\d[A-Z0-9]*(?:([ -])[A-Z]?\d[A-Z0-9]*(?:\1[A-Z]?\d[A-Z0-9]*)*(?:\1[A-Z])?)?(?!\w|[.,]\d)"),
}
# both sides of an at-sign; a local part has 64 characters at most
_AT = re.compile(r"@| ?(?:\(at\)|\[at\]) ?| at ", re.I)
_LOCAL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}$")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_SPELLED = re.compile(r"[\w-]+(?:(?:\.| dot | ?\(dot\) ?| ?\[dot\] ?)[\w-]+)+", re.I)
_DOT = re.compile(r" dot | ?\(dot\) ?| ?\[dot\] ?", re.I)
_HOUSE = re.compile(rf"(?<![\w.,/+-])\d{{1,5}}[A-Za-z]?(?: bis| ter)?,? ({_TOKEN}(?: {_TOKEN})+)")
_ROMANCE = re.compile(
    r"(?<![\w.,/+-])\d{1,5}[A-Za-z]?(?: bis| ter)?,? (rue|avenue|chemin|boulevard|place|all[ée]e|impasse|quai|route) "
    rf"((?:de la |de l['’]|d['’]|des |du |de )?[{_UP}](?:[\w'’-]*\w)?)(?: [{_UP}](?:[\w'’-]*\w)?)*"
)
_IBERIAN = re.compile(
    rf"(?<![\w/+])(Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino) ((?:de los |de las |de la |del |de )?[{_UP}](?:[\w'’-]*\w)?(?: [{_UP}](?:[\w'’-]*\w)?)*),? \d{{1,4}}(?![\w/+])"
)
_GERMAN = re.compile(
    rf"(?<![\w/+])((?:Am |An der |Im |Zum )?[{_UP}][^\W\d_]*(?:-[^\W\d_]+)*?)(stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|ring|damm|ufer) \d{{1,4}} ?[a-z]?(?![\w/+])"
)
# each rule with the words one of which it needs
_STREETS = (
    (_ROMANCE, ("rue ", "avenue ", "chemin ", "boulevard ", "place ", "allée ", "allee ", "impasse ", "quai ", "route ")),
    (_IBERIAN, ("Calle ", "C/ ", "Avenida ", "Avda", "Plaza ", "Paseo ", "Camino ")),
    (_GERMAN, ("straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "gasse ", "ring ", "damm ", "ufer ")),
)
_ESCAPE = re.compile(r'\\(?:u[0-9a-fA-F]{4}|[nrtbf"\\/])')
_PLAIN = {"n": "\v", "r": "\v", "t": "\t", "b": "\v", "f": "\v", '"': '"', "\\": "\\", "/": "/"}
_LABEL_BEFORE = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(LABELS)})\.? $")
_EXTENSION = re.compile(r" ?(?:ext\.?|x) ?\d+$")
_MAIL_BEFORE = re.compile(rf"(?i)(?<!\w){MAIL_WORDS}\W{{0,8}}$|<$")
_WORD_BEFORE = re.compile(r"([^\W\d_]+°?)(?:[^\w\v\n]|[\d_])*$")

FAMILIES = ("name", "number", "mail", "street")
COLUMNS = "doc_id {}, line_no long, first long, last long, family string, k1 string, k2 string, seed string, context string"


def unescape(text: str) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    """Text with JSON escapes read, and where (in the result) how many characters were saved so far."""
    if "\\" not in text:
        return text, None, None
    out, at, saved, pos, n, total = [], [], [], 0, 0, 0
    for m in _ESCAPE.finditer(text):
        a, b = m.span()
        out.append(text[pos:a])
        code = text[a + 1]
        c = chr(int(text[a + 2 : b], 16)) if code == "u" else _PLAIN[code]
        out.append(c)
        n += a - pos + 1
        total += b - a - 1
        at.append(n)
        saved.append(total)
        pos = b
    out.append(text[pos:])
    return "".join(out), np.array(at, np.int64), np.array(saved, np.int64)


def _key(word: str) -> str:
    return word.rstrip(".").lower()


def _names(chain: str, start: int) -> Iterator[tuple[int, int, str, str, str | None]]:
    """(first, last, given or mark, surname, seed) of neighbouring words of a chain."""
    w = [(m.start(), m.end(), m.group()) for m in _ONE.finditer(chain)]
    for i in range(len(w) - 1):
        (a, b, x), (c, d, y) = w[i], w[i + 1]
        comma, kx, ky = chain[b:c].startswith(","), _key(x), _key(y)
        d -= y.endswith(".") and len(y) > 2
        if kx in TITLES and not comma:
            if len(ky) > 1 and ky not in TITLES:
                last = i + 2 == len(w) or chain[w[i + 1][1] : w[i + 2][0]].startswith(",")
                yield start + a, start + d, "<title>", ky, "surname" if last else None
        elif ky in TITLES or len(kx) == 0:
            continue
        elif len(kx) == 1:
            if x.endswith(".") and len(ky) > 1 and not comma:
                yield start + a, start + d, "<initial>", ky, None
        elif len(ky) == 1:
            if y.endswith(".") and not comma and i + 2 < len(w) and len(_key(w[i + 2][2])) > 1:
                z = w[i + 2]
                yield start + a, start + z[1] - (z[2].endswith(".")), kx, _key(z[2]), None
        elif x.endswith("."):
            continue
        elif comma:
            yield start + a, start + d, ky, kx, "comma"
        else:
            yield start + a, start + d, kx, ky, None


def _seeds(s: str) -> Iterator[re.Match]:
    low = s.lower()
    if len(low) != len(s):  # positions would not be the same
        return _SEED.finditer(s)
    return (m for w in _SEED_WORD.finditer(low) if (m := _SEED.match(s, w.start())))


def candidates(text: str) -> list[tuple]:
    """(first, last, family, k1, k2, seed, context) in positions of the text as it stands."""
    s, at, saved = unescape(text)
    out: list[tuple] = []
    for m in _CHAIN.finditer(s):
        for a, b, given, surname, seed in _names(m.group(), m.start()):
            out.append((a, b, "name", given, surname, seed, None))
    def word_before(at_: int) -> str:
        c = _WORD_BEFORE.search(s[max(0, at_ - 48) : at_])
        return c[1].lower() if c else ""

    def number(a: int, b: int, text: str, seed: str | None, word: str | None) -> None:
        shape = re.sub("[A-Z]", "A", re.sub(r"\d", "9", _EXTENSION.sub("", text)))
        out.append((a, b, "number", shape, word, seed, word_before(a)))

    seeds: dict[int, tuple[str, str]] = {}
    listed: set[int] = set()
    for m in _seeds(s):
        seeds[m.end()] = ("phone", m["phone"].lower()) if m["phone"] else ("id_number", m["id"].lower())
    for rule in (_NUMBER, _CODE):
        for m in rule.finditer(s):
            g, begin = m.group(), m.start()
            if g[0] == "(" and ")" not in g:
                g, begin = g[1:], begin + 1
            # a number of its own may stand before it
            head, _, tail = g.partition(" ")
            for x, at_ in ((g, begin), (tail, m.end() - len(tail))) if rule is _NUMBER and head.isdigit() and tail else ((g, begin),):
                seed = seeds.get(at_)
                # without a seed word it must be as long as telephone numbers and papers have it
                if not seed and (not 7 <= sum(map(str.isdigit, x)) <= 18 if rule is _NUMBER else len(x) < 8):
                    continue
                if rule is _NUMBER and x.count(".") == 1 and x.replace(".", "").isdigit():
                    continue
                listed.add(at_)
                number(at_, m.end(), x, *(seed or (None, None)))
    for at_, seed in seeds.items():
        if at_ not in listed and (m := _FOLLOWS[seed[0]].match(s, at_)):
            number(at_, m.end(), m.group(), *seed)
    for m in _AT.finditer(s):
        sign = m.group() == "@"
        d = (_DOMAIN if sign else _SPELLED).match(s, m.end())
        local = _LOCAL.search(s[max(0, m.start() - 65) : m.start()]) if d else None
        if local:
            domain = _DOT.sub(".", d.group()).lower().rstrip(".")
            top = domain.rpartition(".")[2]
            if top.isalpha() and len(top) > 1 and "." in domain:
                begin = m.start() - len(local.group())
                seed = "mail" if sign and _MAIL_BEFORE.search(s[max(0, begin - 24) : begin]) else None
                out.append((begin, d.end(), "mail", local.group().lower(), domain, seed, "@" if sign else "at"))
    for m in _HOUSE.finditer(s):
        if _LABEL_BEFORE.search(s[max(0, m.start() - 16) : m.start()]):
            continue
        w, before = m[1].split(" "), word_before(m.start())
        end = m.start(1) + len(w[0])
        for n in range(1, len(w)):
            end += 1 + len(w[n])
            kind = _key(w[n])
            # the last words of a long name stand for it
            out.append((m.start(), end, "street", " ".join(w[max(0, n - 3) : n]).lower(), kind, "street" if kind in STREET_WORDS else None, before))
    for rule, marks in _STREETS:
        for m in rule.finditer(s) if any(w in s for w in marks) else ():
            name, kind = (m[1], m[2]) if rule is _GERMAN else (m[2], m[1])
            out.append((m.start(), m.end(), "street", name.lower().strip(), kind.lower(), "street", word_before(m.start())))
    if at is not None and len(at) and out:
        spans = np.array([c[:2] for c in out], np.int64)
        add = np.append(0, saved)[np.searchsorted(at, spans, "right")]
        spans += add
        out = [(int(a), int(b), *c[2:]) for (a, b), c in zip(spans.tolist(), out, strict=True)]
    return out


def _list(kind: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                found = candidates(text) if text else []
                if found:
                    lines = [m.start() for m in re.finditer("\n", text)]
                    rows += [(i, bisect_left(lines, c[0]) + 1, *c) for c in found]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            types = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))],
                ["doc_id", "line_no", "first", "last", "family", "k1", "k2", "seed", "context"],
            )

    return run


def list_candidates(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    ship(df.sparkSession)
    rows = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_list(kind), COLUMNS.format(kind))


def settle(known: DataFrame, more: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds what ``more`` makes of the known rows until nothing new comes; ``more`` must not forget."""
    size, before = -1, -2
    while size not in (before, 0):
        seen = Observation()
        rows = known if size < 0 else known.unionByName(more(known))
        # written and counted in one job
        known = cut(rows.distinct().observe(seen, F.count(F.lit(1)).alias("n")))
        before, size = size, seen.get["n"]
    return known


def name_lexicon(cand: DataFrame, share: float = 0.5, support: int = 2) -> tuple[DataFrame, DataFrame]:
    """(given names, surnames), one column ``word`` each, from titles and the graph of word pairs."""
    names = cand.where("family = 'name'")
    # the order of words with a comma between them is open, so they teach nothing
    pairs = cut(names.where("seed IS NULL OR seed <> 'comma'").groupBy("k1", "k2").agg(F.max("seed").alias("seed")))
    inner = pairs.where("NOT startswith(k1, '<')").select("k1", "k2")

    def scored(known: DataFrame, by: str, of: str) -> DataFrame:
        """Words in ``of`` that mostly come with known words in ``by``."""
        mark = inner.join(known.select(F.col("word").alias(by), F.lit(1).alias("hit")), by, "left")
        score = mark.groupBy(of).agg(F.count("*").alias("all"), F.count("hit").alias("hits"))
        return score.where((F.col("hits") >= support) & (F.col("hits") >= share * F.col("all"))).select(F.col(of).alias("word"))

    seeds = pairs.where("seed IS NOT NULL").select(F.col("k2").alias("word"))
    surnames = settle(seeds, lambda known: scored(scored(known, "k2", "k1"), "k1", "k2"))
    return cut(scored(surnames, "k2", "k1")), surnames


#: A number as long as telephone numbers and identity papers are; shorter ones need a better witness than their shape.
_FULL = "length(regexp_replace(k1, '[^9]', '')) >= 7 OR (length(regexp_replace(k1, '[^9A]', '')) >= 7 AND length(regexp_replace(k1, '[^9]', '')) >= 4)"


def number_shapes(cand: DataFrame, share: float = 0.08, support: int = 2, context_share: float = 0.3) -> DataFrame:
    """Accepted shapes ``(k1, kind)``: seeds, and shapes that come in contexts of known ones.

    Digits alone say nothing about what they are: they need a seed word of their own each time.
    """
    numbers = cand.where("family = 'number'").where(_FULL)
    kinds = ("phone", "id_number")
    edges = numbers.groupBy("k1", "context").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("seed") == k, 1)).alias(k) for k in kinds])
    edges = cut(edges.where(~F.col("k1").rlike("^9+$")))
    shape = edges.groupBy("k1").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in kinds])
    most = F.when(F.col("phone") > F.col("id_number"), "phone").otherwise("id_number")
    top = F.greatest(*kinds)

    def more(known: DataFrame) -> DataFrame:
        mark = edges.join(known, "k1", "left").where(F.col("context") != "")
        whole = mark.groupBy("context").agg(F.sum("n").alias("all"))
        ctx = mark.where("kind IS NOT NULL").groupBy("context", "kind").agg(F.count("*").alias("shapes"), F.sum("n").alias("n"))
        ctx = ctx.join(whole, "context").where((F.col("shapes") >= support) & (F.col("n") >= context_share * F.col("all")))
        hits = edges.join(known, "k1", "left_anti").join(ctx.select("context", "kind"), "context").groupBy("k1", "kind").agg(F.sum("n").alias("hits"))
        new = hits.join(shape.select("k1", "n"), "k1").where((F.col("hits") >= support) & (F.col("hits") >= 0.25 * F.col("n")))
        return new.groupBy("k1").agg(F.max_by("kind", F.struct("hits", "kind")).alias("kind"))

    return settle(shape.where((top >= support) & (top >= share * F.col("n"))).select("k1", most.alias("kind")), more)


def seed_words(cand: DataFrame, share: float = 0.5, support: int = 2) -> DataFrame:
    """Seed words ``(k2)`` that mostly have a full number after them; what else follows them is taken too."""
    after = cand.where("family = 'number' AND seed IS NOT NULL").groupBy("k2").agg(F.count("*").alias("all"), F.count_if(F.expr(_FULL)).alias("hits"))
    return after.where((F.col("hits") >= support) & (F.col("hits") >= share * F.col("all"))).select("k2", F.lit(True).alias("good"))


def mail_domains(cand: DataFrame, givens: DataFrame, surnames: DataFrame, share: float = 0.1, support: int = 2) -> DataFrame:
    """Accepted domains ``(k2)``: local parts made of names, or words for mail before them."""
    mails = cand.where("family = 'mail' AND context = '@'").groupBy("k1", "k2").agg(F.max("seed").alias("seed"))
    words = givens.unionByName(surnames).select(F.regexp_replace("word", "[^a-z]", "").alias("part")).where("length(part) > 2").distinct()
    part = F.explode(F.split("k1", r"[^\p{L}]+"))
    parts = mails.select("k1", "k2", part.alias("p")).where("length(p) > 2")
    both = parts.unionByName(parts.select("k1", "k2", F.expr("substring(p, 2)").alias("p")))
    named = both.join(words, both["p"] == words["part"], "left_semi").select("k1", "k2").distinct().withColumn("named", F.lit(1))
    per = mails.join(named, ["k1", "k2"], "left").groupBy("k2").agg(
        F.count("*").alias("all"), F.count(F.when(F.col("named").isNotNull() | F.col("seed").isNotNull(), 1)).alias("hits")
    )
    return per.where((F.col("hits") >= F.least(F.lit(support), F.col("all"))) & (F.col("hits") >= share * F.col("all"))).select("k2")


def street_graph(cand: DataFrame, support: int = 3, share: float = 0.5, doubt: float = 0.25) -> DataFrame:
    """What is known of streets, ``(node, word)``: ``kind`` (street words), ``stem`` (names), ``context`` (words before),
    and ``doubtful`` (words before numbers and names that are mostly no streets)."""
    pairs = cut(cand.where("family = 'street'").groupBy("k1", "k2", "context").agg(F.max("seed").alias("seed")))
    seeds = pairs.where("seed IS NOT NULL").select(F.lit("kind").alias("node"), F.col("k2").alias("word"))
    seeds = seeds.unionByName(pairs.where(F.col("context").isin(*ADDRESS_WORDS)).select(F.lit("context").alias("node"), F.col("context").alias("word")))

    def more(known: DataFrame) -> DataFrame:
        def has(node: str, column: str) -> DataFrame:
            return known.where(F.col("node") == node).select(F.col("word").alias(column), F.lit(1).alias(f"_{node}"))

        d = pairs.join(has("kind", "k2"), "k2", "left").join(has("stem", "k1"), "k1", "left").join(has("context", "context"), "context", "left")
        typed = F.when(F.col("_kind") == 1, 1)
        kind, where = F.when(typed == 1, F.col("k2")), F.when((typed == 1) & (F.col("context") != ""), F.col("context"))
        # two street words or two contexts: the least is not the greatest
        stems = d.groupBy("k1").agg((F.min(kind) < F.max(kind)).alias("kinds"), (F.min(where) < F.max(where)).alias("contexts"), F.max(F.when(typed == 1, F.col("_context"))).alias("told"))
        stems = stems.where("kinds OR contexts OR told = 1").select(F.lit("stem").alias("node"), F.col("k1").alias("word"))
        score = lambda by: d.groupBy(by, "k1").agg(F.max("_stem").alias("hit")).groupBy(by).agg(F.count("*").alias("all"), F.count("hit").alias("hits"))
        good = (F.col("hits") >= support) & (F.col("hits") >= share * F.col("all"))
        kinds = score("k2").where(good).select(F.lit("kind").alias("node"), F.col("k2").alias("word"))
        contexts = score("context").where(good & (F.col("context") != "")).select(F.lit("context").alias("node"), F.col("context").alias("word"))
        return stems.unionByName(kinds).unionByName(contexts)

    known = settle(seeds, more)
    stems = known.where("node = 'stem'").select(F.col("word").alias("k1"), F.lit(1).alias("_stem"))
    first = F.element_at(F.split("k1", " "), 1).alias("first")
    said = pairs.join(stems, "k1", "left").groupBy("context", first).agg(F.max("_stem").alias("hit")).groupBy("context").agg(F.count("*").alias("all"), F.count("hit").alias("hits"))
    bad = said.where((F.col("all") >= support) & (F.col("hits") < doubt * F.col("all"))).select(F.lit("doubtful").alias("node"), F.col("context").alias("word"))
    return known.unionByName(bad)


def find(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no, kind, first, last)`` of every accepted candidate."""
    cand = cut(list_candidates(df, ident, text))
    # one family after the other: side by side their plans together take too much of the driver's memory
    (givens, surnames), shapes, words, graph = (f(cand) for f in (name_lexicon, number_shapes, seed_words, street_graph))
    pos = ["doc_id", "line_no", "first", "last"]
    names = cand.where("family = 'name'").join(surnames.withColumnRenamed("word", "k2"), "k2", "left_semi")
    marked = names.where("startswith(k1, '<')")
    full = names.where("NOT startswith(k1, '<')").join(givens.withColumnRenamed("word", "k1"), "k1", "left_semi")
    people = marked.select(*pos).unionByName(full.select(*pos)).withColumn("kind", F.lit("person_name"))
    numbers = cand.where("family = 'number'").join(shapes, "k1", "left").join(words, "k2", "left")
    # the word before this very number says more than what its shape mostly is
    told = F.when(F.expr(_FULL) | F.col("good"), F.col("seed"))
    numbers = numbers.withColumn("kind", F.coalesce(told, "kind")).where("kind IS NOT NULL").select(*pos, "kind")
    mails = cand.where("family = 'mail'").join(mail_domains(cand, givens, surnames), "k2", "left_semi").select(*pos, F.lit("email").alias("kind"))
    node = lambda n, c: graph.where(F.col("node") == n).select(F.col("word").alias(c))
    streets = cand.where("family = 'street'").join(node("kind", "k2"), "k2", "left_semi")
    streets = streets.join(node("stem", "k1").withColumn("_stem", F.lit(1)), "k1", "left").join(node("doubtful", "context").withColumn("_bad", F.lit(1)), "context", "left")
    # a name that nothing else speaks for is taken where nothing speaks against it
    streets = streets.where("_stem IS NOT NULL OR _bad IS NULL").select(*pos, F.lit("street_address").alias("kind"))
    out = people.unionByName(numbers).unionByName(mails).unionByName(streets)
    return out.withColumnRenamed("doc_id", ident)


def found_lines(spans: DataFrame, ident: str = "doc_id") -> DataFrame:
    return spans.select(ident, "line_no", "kind").distinct()


def redact(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ident, text)`` with every found span replaced by ``<KIND>``.

    Spans are joined back by a digest of the text they are positions of, which also stays the same
    when a task runs again: identifiers may be null, or shared by rows with different texts.
    Overlapping spans become one placeholder, named after the one that begins first.
    """
    rows = df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("_text"))
    spans = find(rows, "_text", "text").groupBy("_text").agg(F.collect_set(F.struct("first", "last", "kind")).alias("spans"))
    both = rows.join(spans, "_text", "left").drop("_text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t, found in zip(f["text"], f["spans"], strict=True):
                if t is None or found is None:
                    out.append(t)
                    continue
                done, pos = [], 0
                for a, neg, k in sorted((x["first"], -x["last"], x["kind"]) for x in found):
                    if a >= pos:
                        done += [t[pos:a], f"<{k.upper()}>"]
                    pos = max(pos, -neg)
                out.append("".join([*done, t[pos:]]))
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": pd.Series(out, dtype=object)})

    return both.mapInPandas(run, f"doc_id {kind}, text string").withColumnRenamed("doc_id", ident)
