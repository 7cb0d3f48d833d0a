"""Licences by sentence rules.

A text is normalised and known licence sentences are found in it, over any line breaks, comment marks
and stops inside them; the identifiers of adjacent known sentences form sequences, and ordered rules take licences out of these sequences,
the most specific rule first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences (letters and digits of public licence texts) and their identifiers.
SENTENCES = {
    "this work is licensed under the gnu general public license version 3": "Gpl3Line",
    "licensed under the gnu general public license version 3": "Gpl3Line",
    "licensed under the gnu general public license version 2": "Gpl2Line",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 3 of "
    "the license or at your option any later version": "Gpl3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 2 of "
    "the license or at your option any later version": "Gpl2Plus",
    "this program is distributed in the hope that it will be useful but without any warranty without "
    "even the implied warranty of merchantability or fitness for a particular purpose": "GnuNoWarranty",
    "see the gnu general public license for more details": "GplSee",
    "released under the mit license": "MitLine",
    "licensed under the mit license": "MitLine",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do "
    "so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not "
    "limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement": "MitNoWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection "
    "with the software or the use or other dealings in the software": "MitNoLiability",
    "licensed under the apache license version 2 0": "ApacheLine",
    "licensed under the apache license version 2 0 the license": "ApacheLine",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "https www apache org licenses license 2 0": "ApacheUrl",
    "see the license for the specific language governing permissions and limitations under the "
    "license": "ApacheSee",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and "
    "the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the "
    "distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written "
    "permission": "BsdEndorse",
    "all rights reserved": "AllRights",
}
# Ordered rules, each a sequence of identifiers and the licence that it stands for.
RULES = [
    (("MitGrant", "MitNotice", "MitNoWarranty", "MitNoLiability"), "MIT"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("ApacheLine", "ApacheUse", "ApacheCopy", "ApacheUrl"), "Apache-2.0"),
    (("ApacheLine", "ApacheUse"), "Apache-2.0"),
    (("Gpl3Plus", "GnuNoWarranty", "GplSee"), "GPL-3.0-or-later"),
    (("Gpl2Plus", "GnuNoWarranty", "GplSee"), "GPL-2.0-or-later"),
    (("Gpl3Plus",), "GPL-3.0-or-later"),
    (("Gpl2Plus",), "GPL-2.0-or-later"),
    (("Gpl3Line",), "GPL-3.0-only"),
    (("Gpl2Line",), "GPL-2.0-only"),
    (("ApacheLine",), "Apache-2.0"),
    (("MitLine",), "MIT"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("CcByNc4",), "CC-BY-NC-4.0"),
    (("CcBySa4",), "CC-BY-SA-4.0"),
    (("CcBy4",), "CC-BY-4.0"),
    (("AllRights",), "proprietary"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = "\x01"


_SPACE = r"[ \t\n\r\f]"
#: First words of the longer sentences: with a capital they begin a sentence without a stop before,
#: as behind the copyright line of a text that stands on one line.
_HEADS = "|".join(sorted({" ".join(x.capitalize().split(" ")[:2]) for x in SENTENCES
                          if x.count(" ") >= 7 and not x.startswith("http")}))


def _pattern(sentence: str) -> str:
    """The sentence's words from one boundary to the next, whatever boundaries lie among them."""
    return f"[ {_BREAK}]+".join(sentence.split(" "))


def marked(text: Column) -> Column:
    """The text in words of a-z and 0-9, with a mark at each place where a sentence may begin or end:
    . ; : ! ? before white space, a line's end unless the next line goes on with a small letter,
    before the capital of a longer sentence's first words, both ends of an address, both sides of a
    list number."""
    # A run of white space becomes one character first, so that no later pattern meets a long run.
    out = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    out = F.regexp_replace(out, f"([.;:!?]){_SPACE}", f"$1{_BREAK}")
    out = F.regexp_replace(out, r"\n([^a-z])", f"{_BREAK}$1")
    out = F.regexp_replace(out, f"{_SPACE}({_HEADS}) ", f"{_BREAK}$1 ")
    out = F.regexp_replace(out, rf"(https?://[^ \t\n\r\f{_BREAK}]+)", f"{_BREAK}$1{_BREAK}")
    # a list number, behind comment marks or none, is no word of the sentence that it leads in
    out = F.regexp_replace(out, rf"(^|\n|{_BREAK})([^a-zA-Z0-9\n{_BREAK}]*)(?:[0-9]{{1,3}}|[a-zA-Z])"
                                rf"[.)][ \t\n\r\f{_BREAK}]+", f"$1$2{_BREAK}")
    lower = F.translate(out, _UPPER, _LOWER)
    plain = F.regexp_replace(lower, f"[^a-z0-9{_BREAK}]+", " ")
    plain = F.concat(F.lit(_BREAK), plain, F.lit(_BREAK))
    return F.regexp_replace(plain, f"[ {_BREAK}]*{_BREAK}[ {_BREAK}]*", _BREAK)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, licenses, unmatched) of the documents with a known sentence.

    `licenses`: what the rules found, in the rules' order, joined by commas; `unmatched`:
    identifiers that no rule took. A null or empty text has no sentence and gives no row. Each row is
    judged by itself, also rows of one id and rows without an id. Sentences without a letter do not
    part adjacent ones. Other columns are left out. Nothing is shuffled.
    """
    longest_first = sorted(SENTENCES, key=lambda x: (-len(x), x))
    some = f"{_BREAK}(?:{'|'.join(map(_pattern, longest_first))}){_BREAK}"
    found = docs.select(docs[doc_id].alias("doc_id"), marked(docs[text].cast("string")).alias("t"))
    found = found.where(F.col("t").rlike(some))
    t = F.col("t")
    for sentence in longest_first:  # few documents are left here; identifiers have capitals, words none
        t = F.regexp_replace(t, f"{_BREAK}{_pattern(sentence)}(?={_BREAK})",
                             f"{_BREAK}@{SENTENCES[sentence]}")
    parts = F.filter(F.split(t, _BREAK), lambda x: x.rlike("[a-z]"))
    hits = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("place"), F.substring(x, 2, 99).alias("ident"), x.startswith("@").alias("known"))),
                    lambda x: x["known"])
    return _rules(found.select("doc_id", hits.alias("hits")).where(F.size("hits") > 0)
                  .select("doc_id", F.size("hits").cast("long").alias("n_sentences"), "hits"))


def _rules(sequences: DataFrame) -> DataFrame:
    """Sequences as text: adjacent identifiers are joined by >, gaps are marked by a bar."""
    joined = F.expr(
        "aggregate(hits, named_struct('last', -2, 'text', ''), (a, x) -> named_struct('last', x.place,"
        " 'text', concat(a.text, if(x.place <= a.last + 1, '>', '|>'), x.ident, '>')), a -> a.text)")
    out = sequences.select("doc_id", "n_sentences", F.regexp_replace(joined, ">+", ">").alias("left"),
                           F.lit("").alias("found"))
    for idents, licence in RULES:
        pattern = ">" + ">".join(idents) + ">"
        has = F.contains("left", F.lit(pattern))
        out = out.select(
            "doc_id", "n_sentences", F.replace("left", F.lit(pattern), F.lit(">*>")).alias("left"),
            F.when(has & ~F.contains(F.concat(F.lit(","), "found", F.lit(",")), F.lit(f",{licence},")),
                   F.concat("found", F.when(F.col("found") == "", "").otherwise(","), F.lit(licence)))
            .otherwise(F.col("found")).alias("found"))
    rest = F.array_join(F.filter(F.split("left", "[>|*]+"), lambda x: x != ""), ",")
    return out.select("doc_id", "n_sentences", F.nullif("found", F.lit("")).alias("licenses"),
                      F.nullif(rest, F.lit("")).alias("unmatched"))


def oracle() -> str:
    """The same for DuckDB over `documents`."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    steps = ["SELECT doc_id, n_sentences, regexp_replace(text, '>+', '>', 'g') AS l, '' AS f FROM joined"]
    for idents, licence in RULES:
        pattern = quoted(">" + ">".join(idents) + ">")
        name = quoted(licence)
        steps.append(
            f"SELECT doc_id, n_sentences, replace(l, {pattern}, '>*>') AS l, CASE WHEN contains(l, "
            f"{pattern}) AND NOT list_contains(string_split(f, ','), {name}) THEN f || CASE WHEN f = "
            f"'' THEN '' ELSE ',' END || {name} ELSE f END AS f FROM r{len(steps) - 1}")
    rules = ", ".join(f"r{i} AS MATERIALIZED ({s})" for i, s in enumerate(steps))
    space = "[ \\t\\n\\r\\f]"
    return f"""
WITH known(sentence, ident) AS (VALUES {known}),
marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.;:!?]){space}+', '\\1' || chr(1), 'g'),
  '\\n{space}*([^a-z \\t\\n\\r\\f])', chr(1) || '\\1', 'g') AS t FROM documents),
plain AS (SELECT doc_id, regexp_replace(translate(t, '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\x01]+', ' ', 'g') AS t
  FROM marked),
parts AS (SELECT doc_id, string_split(regexp_replace(t, ' *\\x01 *', chr(1), 'g'), chr(1)) AS s FROM plain),
each AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS place FROM parts),
hits AS (SELECT doc_id, place, ident FROM each JOIN known ON trim(each.sentence, ' ') = known.sentence),
linked AS (SELECT doc_id, place, ident, CASE WHEN place <= coalesce(lag(place) OVER
  (PARTITION BY doc_id ORDER BY place, ident), -2) + 1 THEN '>' ELSE '|>' END AS gap FROM hits),
joined AS (SELECT doc_id, count(*) AS n_sentences,
  string_agg(gap || ident || '>', '' ORDER BY place, ident) AS text FROM linked GROUP BY doc_id),
{rules}
SELECT doc_id, n_sentences, nullif(f, '') AS licenses, nullif(array_to_string(list_filter(
  regexp_split_to_array(l, '[>|*]+'), lambda x: x <> ''), ','), '') AS unmatched FROM r{len(steps) - 1}
"""
