"""Licence scan by a positional index of rare tokens, in DataFrame functions alone.

Over all texts, the document frequency of every word of the licence texts is counted. The index holds, of each
template, the places of its rarest words. A text looks up the indexed words that it has: every place of such a word,
less its place in a template, is where that template may begin. Where enough rare words agree on one beginning, the
template's mandatory key phrases are verified word by word and the rest of it is weighed by IDF.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import BASE, TEXTS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's IDF that must lie at the right places once its key phrases are verified.
LEAST_SHARE = 0.5
#: Rare words that the index holds of a template, and how many of them must agree on where it begins. Of templates
#: shorter than SHORT words, the rarest one decides.
RARE, AGREE, SHORT = 8, 3, 24


@dataclass
class Template:
    label: str
    words: list[str]
    #: (place in the template, words) of the phrases that must be there.
    keys: list[tuple[int, list[str]]]
    base: bool

    @property
    def rare(self) -> int:
        return RARE if len(self.words) >= SHORT else 1

    @property
    def agree(self) -> int:
        return AGREE if len(self.words) >= SHORT else 1


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def templates() -> list[Template]:
    """The base phrases, which are their own key phrases, and the licence texts."""
    out = [Template(label, phrase.split(), [(0, phrase.split())], True) for label, phrase in BASE]
    for label, keys, text in TEXTS:
        words = words_in(text)
        at = [(next(i for i in range(len(words)) if words[i : i + len(k)] == k), k) for k in map(str.split, keys)]
        out.append(Template(label, words, at, False))
    return out


def words_of(text: str = "text") -> Column:
    """Words of a text after A-Z are lower-cased; null has none.

    Split at what is no word: matching the words one by one would copy the whole text for each of them.
    """
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), APART), "")


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def idf_of(docs: DataFrame, forms: list[Template]) -> dict[str, float]:
    """IDF over all texts of every template word. The driver gets a number for each such word, whatever the corpus."""
    vocabulary = sorted({w for t in forms for w in t.words})
    counts = docs.select(F.explode(F.array_distinct(F.filter(words_of(), lambda w: w.isin(vocabulary)))).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in counts.collect()}
    n = docs.count()
    return {w: round(math.log((n + 1) / (df.get(w, 0) + 1)) + 1, 9) for w in vocabulary}


def postings(form: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """(word, place) of the template's rarest words; of equally rare ones, those that come first.

    One that decides alone is a word of the key phrases, which a text can't do without.
    """
    first = {w: i for i, w in reversed(list(enumerate(form.words)))}
    must = {w for _, k in form.keys for w in k}
    rare = set(sorted(must if form.agree == 1 else first, key=lambda w: (-idf[w], first[w]))[: form.rare])
    return [(w, i) for i, w in enumerate(form.words) if w in rare]


def _places(words: Column, hits: Column, form: Template, idf: dict[str, float]) -> Column:
    """array<struct(at, share)>: where the template begins, and the share of its IDF that lies there.

    hits: array<struct(word, i)> of the indexed words that the text has.
    """
    total = math.fsum(idf[w] for w in form.words)
    found = postings(form, idf)
    # each hit's beginnings by the template's postings of its word
    starts = F.flatten(F.transform(hits, lambda h: F.array_compact(F.array(*[F.when(h["word"] == w, h["i"] - i) for w, i in found]))))
    if form.agree == 1:
        agreed = F.array_distinct(starts)
    else:
        # the number of postings that agree on a beginning: how often it stands in the sorted list
        line = F.array_sort(starts)
        last = form.agree - 1
        agreed = F.array_distinct(F.filter(line, lambda s, i: F.coalesce(F.try_element_at(line, i + 1 + last) == s, F.lit(False))))
    there = lambda s, at, k: (s + at >= 0) & (F.slice(words, F.greatest(s + at, F.lit(0)) + 1, len(k)) == _literals(k))

    def verified(s: Column) -> Column:
        out = F.lit(True)
        for at, k in form.keys:
            out = out & there(s, at, k)
        return out

    held = F.filter(agreed, verified)
    every, weights = _literals(form.words), F.array(*[F.lit(idf[w]) for w in form.words])
    pairs = F.arrays_zip(every.alias("word"), weights.alias("idf"))
    # places before the text are asked for apart, for try_element_at counts from the end below 0
    weighed = lambda s: F.aggregate(F.transform(pairs, lambda p, j: F.when((s + j >= 0) & (F.try_element_at(words, F.greatest(s + j + 1, F.lit(1))) == p["word"]), p["idf"]).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    # a phrase that is verified as a whole has all of its weight
    share = (lambda s: F.lit(1.0)) if len(form.keys) == 1 and form.keys[0][1] == form.words else (lambda s: F.round(weighed(s) / F.lit(total), 6))
    listed = F.transform(held, lambda s: F.struct((s + form.keys[0][0]).cast("long").alias("at"), share(s).alias("share")))
    return F.filter(listed, lambda f: f["share"] >= LEAST_SHARE)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score of the whole text.

    Places are where a (first) key phrase begins, in words from 0; n_base, first_word and last_word are of the base phrases.
    score is the largest share of a template's IDF found, 0 without one. Null and empty texts have no words, no labels
    and null first_word and last_word. Input columns of the same names are replaced, other extra columns stay;
    repeated rows each get their result; an empty table stays empty. Rows are scanned where they are: only the counts
    of template words are shuffled.
    """
    forms = templates()
    idf = idf_of(docs.select("text"), forms)
    index = sorted({w for t in forms for w, _ in postings(t, idf)})
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    worded = docs.select(*own, words_of().alias("__words"))
    words = F.col("__words")
    seen = worded.select(*own, "__words", F.array_distinct(F.filter(words, lambda w: w.isin(index))).alias("__rare"))
    # the places of the indexed words that a text has; most texts have none
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda h: F.array_contains("__rare", h["word"]))
    none = F.array().cast("array<array<struct<at:bigint,share:double>>>")
    placed = seen.select(*own, "__words", F.when(F.size("__rare") > 0, hits).alias("__hits"))
    all_places = F.array(*[_places(words, F.col("__hits"), t, idf) for t in forms])
    found = placed.select(*own, F.size(words).cast("long").alias("n_words"), F.when(F.col("__hits").isNull(), none).otherwise(all_places).alias("__found"))
    hit = lambda i: F.coalesce(F.size(F.get("__found", F.lit(i))) > 0, F.lit(False))
    base = F.flatten(F.slice("__found", 1, len(BASE)))
    labels = lambda n: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(hit(i), t.label) for i, t in enumerate(forms[:n])]), lambda x: x.isNotNull()))), ",")
    return found.select(
        *own,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["at"]).alias("first_word"),
        F.array_max(base["at"]).alias("last_word"),
        labels(len(BASE)).alias("base_labels"),
        labels(len(forms)).alias("labels"),
        F.coalesce(F.array_max(F.flatten("__found")["share"]), F.lit(0.0)).alias("score"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs.select("doc_id", "text")).drop("text")


def oracle() -> str:
    """DuckDB SQL for the rows of op7: the postings are joined to every word of every text."""
    forms = templates()
    rows = ", ".join(f"({i}, '{t.label}', {t.base}, {t.words!r}, {t.rare}, {t.agree}, {t.keys[0][0]}, {len(t.keys) == 1 and t.keys[0][1] == t.words})" for i, t in enumerate(forms))
    keys = ", ".join(f"({i}, {at}, {k!r})" for i, t in enumerate(forms) for at, k in t.keys)
    return f"""
WITH t(no, label, base, words, rare, agree, key_at, whole) AS (VALUES {rows}), k(no, spot, phrase) AS (VALUES {keys}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tw AS (SELECT no, rare, unnest(words) AS word, unnest(range(len(words))) AS j FROM t),
df AS MATERIALIZED (SELECT v.word, round(ln(((SELECT count(*) FROM d) + 1) / (count(x.word) + 1)) + 1, 9) AS idf
       FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN (SELECT r, unnest(list_distinct(w)) AS word FROM d) x ON x.word = v.word GROUP BY v.word),
kw AS (SELECT DISTINCT no, unnest(phrase) AS word FROM k),
fw AS (SELECT tw.no, tw.rare, t.agree, tw.word, min(j) AS j FROM tw JOIN t USING (no) GROUP BY ALL),
ra AS (SELECT no, word FROM (SELECT no, rare, word, row_number() OVER (PARTITION BY no ORDER BY df.idf DESC, j) AS place
       FROM fw JOIN df USING (word) LEFT JOIN kw USING (no, word) WHERE fw.agree > 1 OR kw.word IS NOT NULL) WHERE place <= rare),
po AS (SELECT no, word, j FROM tw JOIN ra USING (no, word)),
p AS (SELECT d.r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
c AS (SELECT p.r, po.no, p.i - po.j AS s FROM p JOIN po USING (word) JOIN t ON t.no = po.no GROUP BY p.r, po.no, p.i - po.j, t.agree HAVING count(*) >= t.agree),
g AS (SELECT c.r, c.no, c.s FROM c JOIN k ON k.no = c.no JOIN d ON d.r = c.r GROUP BY c.r, c.no, c.s HAVING bool_and(c.s + k.spot >= 0 AND d.w[c.s + k.spot + 1 : c.s + k.spot + len(k.phrase)] = k.phrase)),
s AS (SELECT g.r, g.no, g.s, sum(CASE WHEN g.s + tw.j >= 0 AND d.w[g.s + tw.j + 1] = tw.word THEN df.idf ELSE 0 END) / sum(df.idf) AS part
      FROM g JOIN tw ON tw.no = g.no JOIN df ON df.word = tw.word JOIN d ON d.r = g.r GROUP BY g.r, g.no, g.s),
f AS (SELECT s.r, s.s + t.key_at AS i, t.base, t.label, CASE WHEN t.whole THEN 1.0 ELSE round(part, 6) END AS share FROM s JOIN t ON t.no = s.no),
h AS (SELECT r, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM f WHERE share >= {LEAST_SHARE} GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN h USING (r)"""
