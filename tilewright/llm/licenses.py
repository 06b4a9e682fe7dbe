"""Licence scans over a positional index of rare licence words, in DataFrame functions only.

Each licence template is a sequence of words. A pass over the corpus counts in how many documents each template word occurs;
the postings say, for each word that is among the rarest (highest-IDF) ones of a template, in which templates it stands and
where. A file's own such words are looked up there, each with its places in the file; the places, less the posting's, are
intersected between the words of a template, and at what remains the whole mandatory phrase is verified. Every occurrence of
a phrase holds its rare words at their offsets, so none is missed, whatever the counts. The postings are one constant of the
plan, which doesn't get longer with the number of templates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Words of lower-cased text: digits, a-z and everything beyond ASCII. The possessive form never backtracks.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"


class Template(NamedTuple):
    label: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("gfdl", "gnu free documentation license"),
    Template("apache-2", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal"),
    Template("creative-commons", "creative commons attribution"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification"),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words by which a template is indexed.
RARE = 2
#: How many of these numbers a template has.
_ONE = RARE * (RARE + 1)
#: Places of words are below this.
PLACE_BITS = 32
PLACES = 1 << PLACE_BITS
#: What a document scores by rare words alone, without a verified phrase, at most.
UNVERIFIED = 0.5


def lowered(text: Column) -> Column:
    """Lower case, by the fast built-in function instead of one that maps A-Z alone. Words stay words and keep their places; the one
    other letter that becomes an ASCII one, the Kelvin sign, is replaced first, so no foreign word turns into a template's."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def tokens(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def document_counts(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """In how many documents each template word occurs; as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    own = F.array_distinct(F.filter(tokens(lowered(F.col(text_col))), lambda w: w.isin(vocabulary)))
    counted = docs.select(F.explode(own).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r.w: r["count"] for r in counted}


def rarest(template: Template, counts: dict[str, int]) -> list[tuple[str, int]]:
    """(word, position) of the RARE words that the fewest documents have, in that order; ties by the word."""
    first = {w: k for k, w in reversed(list(enumerate(template.words)))}
    return [(w, first[w]) for w in sorted(first, key=lambda w: (counts[w], w))[:RARE]]


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def postings(templates: tuple[Template, ...], counts: dict[str, int]) -> dict[str, list[tuple[int, int, int, int]]]:
    """By word: (template, position in it, which of its rare words this is, how many it has)."""
    out: dict[str, list[tuple[int, int, int, int]]] = {}
    for k, t in enumerate(templates):
        rare = rarest(t, counts)
        for r, (w, at) in enumerate(rare):
            out.setdefault(w, []).append((k, at, r, len(rare)))
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, counts: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, matches array<struct<label,base,start>> (every place of every phrase), best (share of rare words).

    Null and empty texts have no words. Overlapping places all count; repeated rows repeat; other columns are left aside. Without
    templates nothing is found. No shuffle beyond the counts.
    """
    counts = document_counts(docs, templates, text_col) if counts is None else counts
    index = postings(templates, counts)
    keys = sorted({w for w, own in index.items() if any(r == 0 for _, _, r, _ in own)})
    entry = lambda p: F.struct(*[F.lit(x).alias(n) for n, x in zip(("t", "at", "r", "n"), p)])
    looked = F.create_map(*[x for w, own in index.items() for x in (F.lit(w), F.array(*map(entry, own)))]) if index else None
    phrases, labels, bases = (F.array(*x) for x in ([F.array(*map(F.lit, t.words)) for t in templates], [F.lit(t.label) for t in templates], [F.lit(t.base) for t in templates]))
    none = F.struct(F.array().cast("array<struct<label:string,base:boolean,start:bigint>>").alias("matches"), F.lit(0.0).alias("best"))

    def found(t: Column) -> Column:
        n_words = F.size(t).cast("bigint").alias("n_words")
        if not index:
            return F.struct(n_words, none.alias("found"))
        hits = F.filter(F.transform(t, lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: x["w"].isin(*index))
        posted = F.flatten(F.transform(hits, lambda x: F.transform(F.try_element_at(looked, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["k"] - p["at"]).alias("start"), p["r"].alias("r"), p["n"].alias("n")))))

        def placed(ps: Column) -> Column:
            # a template and a start are one number: numbers are intersected by hash, structs by comparing all with all
            of = lambda r, n: F.transform(F.filter(ps, lambda p: (p["r"] == r) & n(p["n"]) & (p["start"] >= 0)), lambda p: p["t"].cast("bigint") * PLACES + p["start"])
            starts = of(0, lambda n: n == 1)
            for n in range(2, RARE + 1):
                both = of(0, lambda x, n=n: x == n)
                for r in range(1, n):
                    both = F.array_intersect(both, of(r, lambda x, n=n: x == n))
                starts = F.concat(starts, both)
            of_template = lambda array, s: F.element_at(array, F.shiftright(s, PLACE_BITS).cast("int") + 1)
            start = lambda s: s.bitwiseAND(F.lit(PLACES - 1))
            whole = F.filter(starts, lambda s: F.slice(t, (start(s) + 1).cast("int"), F.size(of_template(phrases, s))) == of_template(phrases, s))
            matches = F.transform(whole, lambda s: F.struct(of_template(labels, s).alias("label"), of_template(bases, s).alias("base"), start(s).alias("start")))
            present = F.array_distinct(F.transform(ps, lambda p: (p["t"] * RARE + p["r"]) * (RARE + 1) + p["n"]))
            best = _let(present, lambda own: F.array_max(F.transform(own, lambda p: F.size(F.filter(own, lambda q: F.floor(q / _ONE) == F.floor(p / _ONE))) / (p % (RARE + 1)))))
            return F.struct(matches.alias("matches"), F.coalesce(best, F.lit(0.0)).alias("best"))

        return F.struct(n_words, F.when(F.exists(t, lambda w: w.isin(keys)), _let(posted, placed)).otherwise(none).alias("found"))

    got = docs.select(docs[id_col].alias(id_col), _let(tokens(lowered(docs[text_col])), found).alias("x"))
    return got.select(id_col, "x.n_words", "x.found.matches", "x.found.best")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """op1's columns from scan()'s. score: 1 with a verified phrase, else UNVERIFIED times the best share of rare words."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    score = F.when(F.size("matches") > 0, 1.0).otherwise(F.col("best") * UNVERIFIED)
    return found.select(id_col, "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), score.alias("score"))


def oracle_sql() -> str:
    """The same in DuckDB SQL, by comparing words at every place instead of an index."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    listed = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.words})" for k, t in enumerate(TEMPLATES))
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    p(k, label, base, words) AS (VALUES {listed}),
    v AS (SELECT DISTINCT k, unnest(words) AS word FROM p),
    own AS (SELECT r, list_filter(list_distinct(w), lambda x: list_contains({vocabulary}, x)) AS ws FROM t),
    df AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM own) GROUP BY 1),
    rare AS (SELECT k, word FROM v LEFT JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), word) <= {RARE}),
    lead AS (SELECT k, word FROM v LEFT JOIN df USING (word) QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), word) = 1),
    tok AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t),
    hit AS (SELECT tok.r, tok.pos, p.label, p.base FROM tok JOIN p ON tok.word = p.words[1] JOIN t ON t.r = tok.r WHERE t.w[tok.pos + 1 : tok.pos + len(p.words)] = p.words),
    agg AS (SELECT r, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY 1),
    led AS (SELECT DISTINCT r FROM (SELECT r, unnest(ws) AS word FROM own) JOIN lead USING (word)),
    share AS (SELECT r, max(n) AS best FROM (SELECT o.r, rare.k, count(*) / any_value(s.size)::DOUBLE AS n FROM (SELECT r, unnest(ws) AS word FROM own WHERE r IN (SELECT r FROM led)) o JOIN rare USING (word) JOIN (SELECT k, count(*) AS size FROM rare GROUP BY 1) s USING (k) GROUP BY 1, 2) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      CASE WHEN labels IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(best, 0) * {UNVERIFIED}::DOUBLE END AS score
    FROM t LEFT JOIN agg USING (r) LEFT JOIN share USING (r)"""
