"""Licence recognition by sentence rules.

Each text is normalised to words and the marks between them, and known licence
sentences are looked for between two marks.  Line ends and ;: are marks that a
sentence may go across, so texts may be wrapped and commented out; full stops and
empty lines are marks that it may not.  What is left of a text is a sequence of
identifiers, against which ordered rules are matched: a rule is itself a
sequence of identifiers that must follow one another.  Earlier rules come first,
and the identifiers a rule has used are not used again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.rows import packed, unpacked
from pagewright.plans.session import table

NAME = "op6_license_scan"

#: One-line notices and beginnings of sentences, as the SQL has them.
SHORT_SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "a1"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "a2"),
    ("the software is provided as is without warranty of any kind express or implied", "a3"),
    ("released under the mit license", "a4"),
    ("licensed under the mit license", "a4"),
    ("this project is licensed under the mit license", "a4"),
    ("licensed under the apache license version 2 0", "b1"),
    ("you may not use this file except in compliance with the license", "b2"),
    ("you may obtain a copy of the license at", "b3"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "b4"),
    ("this work is licensed under the gnu general public license version 3", "c1"),
    ("this work is licensed under the gnu general public license version 2", "c2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "c3"),
    ("this program is distributed in the hope that it will be useful but without any warranty", "c4"),
    ("licensed under cc by nc 4 0", "d1"),
    ("licensed under cc by 4 0", "d2"),
    ("licensed under cc by sa 4 0", "d3"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "d2"),
    ("all rights reserved", "e1"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "f1"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "f2"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "f3"),
)

_MIT, _GPL = "this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "* is free software you can redistribute it and or modify it under the terms of the gnu general public license"
_APACHE = "https www apache org licenses license 2 0"
_LESSER, _AFFERO, _LIBRARY = (_GPL.replace("gnu general", f"gnu {x} general") for x in ("lesser", "affero", "library"))


def _published(v: str) -> tuple[str, ...]:
    """The usual ways to name version ``v`` of a licence of the foundation."""
    return (
        f"as published by the free software foundation either version {v} of the license or at your option any later version",
        f"as published by the free software foundation either version {v} of the license or any later version",
        f"as published by the free software foundation either version {v} of the license",
        f"as published by the free software foundation version {v} of the license",
        f"as published by the free software foundation version {v}",
        f"version {v} as published by the free software foundation",
        f"version {v}",
    )


#: The Creative Commons licences that are spelled by rule, their names in full, and their versions.
CC_NAMES = {"by": "attribution", "by nc": "attribution noncommercial", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = {"2 0": "generic", "2 5": "generic", "3 0": "unported", "4 0": "international"}
#: Those that the one-line notices know have short identifiers.
_CC_SHORT = {"by nc 4 0": "d1", "by 4 0": "d2", "by sa 4 0": "d3"}


def _cc_id(kind: str, version: str) -> str:
    return _CC_SHORT.get(f"{kind} {version}", f"cc {kind} {version}")


def _cc_sentences() -> tuple:
    out = []
    for kind, name in CC_NAMES.items():
        for version, scope in CC_VERSIONS.items():
            full = f"creative commons {name} {version}"
            ways = [f"{x}licensed under {y}{z}" for x in ("this work is ", "") for y, z in ((f"cc {kind} {version}", ""), ("a ", f"{full} {scope} license"), ("the ", f"{full} {scope} license"), ("a ", f"{full} license"), ("the ", f"{full} license"))]
            out += [(w, _cc_id(kind, version)) for w in (*ways, f"spdx license identifier cc {kind} {version}")]
    return tuple(out)


def _cc_rules() -> tuple:
    return tuple((f"cc-{kind.replace(' ', '-')}-{version.replace(' ', '.')}", "notice", (_cc_id(kind, version),), "nc" not in kind and "nd" not in kind) for kind in CC_NAMES for version in CC_VERSIONS if f"{kind} {version}" not in _CC_SHORT)


#: Full sentences of licences and their usual variants; a star is one to eight words.
FULL_SENTENCES = (
    (f"permission is hereby granted free of charge to any person obtaining a copy of {_MIT}", "a1"),
    ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software", "a2"),
    *((f"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {x}", "a3") for x in ("noninfringement", "non infringement")),
    *((f"{x} under the {y}mit license{z}", "a4") for x in ("this project is licensed", "this software is licensed", "this software is released") for y in ("", "terms of the ") for z in ("", " see the license file for details", " see license file for details", " see the license license file for details", " see the license md file for details", " see the license md license md file for details", " see the license license md file for details")),
    *((f"{x} under the terms of the mit license", "a4") for x in ("licensed", "released", "distributed")),
    ("distributed under the mit license", "a4"),
    *((f"{x} the apache license version 2 0 the license", "b1") for x in ("licensed under", "the asf licenses this file to you under", "* licenses this file to you under")),
    *((f"you may obtain a copy of the license at {x}", "b3") for x in (_APACHE, _APACHE.replace("https", "http"))),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "b4"),
    ("apache license version 2 0 january 2004", "b5"),
    *((f"{_GPL} {x}", i) for v, i in (("3", "c3"), ("2", "c5")) for x in _published(v)),
    *((f"{text} {x}", i) for text, v, i in ((_LESSER, "2 1", "l1"), (_LESSER, "3", "l3"), (_LIBRARY, "2", "l2"), (_AFFERO, "3", "n1")) for x in _published(v)),
    ("gnu lesser general public license version 2 1 february 1999", "l4"),
    ("gnu lesser general public license version 3 29 june 2007", "l5"),
    ("gnu affero general public license version 3 19 november 2007", "n2"),
    (f"{_GPL} as published by the free software foundation", "c6"),
    ("* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "c4"),
    ("* is distributed in the hope that it will be useful but without any warranty", "c4"),
    ("gnu general public license version 3 29 june 2007", "c7"),
    ("gnu general public license version 2 june 1991", "c8"),
    ("this source code form is subject to the terms of the mozilla public license v", "m1"),
    *((f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0", "m2") for x in ("https", "http")),
    ("mozilla public license version 2 0", "m3"),
    *((f"permission to use copy modify {x} distribute this software {y}for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "g1") for x in ("and or", "and") for y in ("", "and its documentation ")),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "g3"),
    *((f"the software is provided as is and {x} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "g2") for x in ("the author", "isc", "the copyright holder")),
    ("this is free and unencumbered software released into the public domain", "h1"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "h2"),
    ("cc0 1 0 universal", "d0"),
    ("creative commons cc0 1 0 universal", "d0"),
    ("licensed under cc0 1 0", "d0"),
    ("this work is licensed under cc0 1 0", "d0"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer without modification", "f2"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "f3"),
    ("neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission", "f4"),
    ("the name of * may not be used to endorse or promote products derived from this software without specific prior written permission", "f4"),
    ("all advertising materials mentioning features or use of this software must display the following acknowledgement", "f5"),
    *((f"spdx license identifier {x}", i) for x, i in (
        ("mit", "a4"), ("apache 2 0", "b1"), ("bsd 2 clause", "f6"), ("bsd 3 clause", "f7"),
        *((f"{x}{y}", i) for x, i in (("gpl 3 0", "c1"), ("gpl 2 0", "c2"), ("lgpl 2 1", "l6"), ("lgpl 3 0", "l7"), ("agpl 3 0", "n3")) for y in ("", " only", " or later")),
        ("mpl 2 0", "m3"), ("isc", "g4"), ("0bsd", "g5"), ("unlicense", "h3"), ("cc0 1 0", "d0"),
    )),
)

#: Known sentences of licences, normalised, with their identifiers.
SENTENCES = tuple(dict((*_cc_sentences(), *FULL_SENTENCES, *SHORT_SENTENCES)).items())

#: Rules over notices and beginnings, as the SQL has them.
SHORT_RULES = (
    ("mit", "full", ("a1", "a2", "a3"), True),
    ("apache-2.0", "full", ("b1", "b2", "b3", "b4"), True),
    ("bsd-2-clause", "full", ("f1", "f2", "f3"), True),
    ("gpl-3.0", "full", ("c3", "c4"), False),
    ("mit", "notice", ("a4",), True),
    ("apache-2.0", "notice", ("b1",), True),
    ("gpl-3.0", "notice", ("c1",), False),
    ("gpl-2.0", "notice", ("c2",), False),
    ("cc-by-nc-4.0", "notice", ("d1",), False),
    ("cc-by-sa-4.0", "notice", ("d3",), True),
    ("cc-by-4.0", "notice", ("d2",), True),
    ("mit", "part", ("a1",), True),
    ("all-rights-reserved", "notice", ("e1",), False),
)


#: Rules in the order in which they are tried; whether the licence permits reuse for training.
RULES = (
    ("bsd-4-clause", "full", ("f1", "f2", "f3", "f5", "f4"), True),
    ("bsd-3-clause", "full", ("f1", "f2", "f3", "f4"), True),
    ("gpl-2.0", "full", ("c5", "c4"), False),
    ("gpl", "full", ("c6", "c4"), False),
    ("lgpl-2.1", "full", ("l1", "c4"), False),
    ("lgpl-3.0", "full", ("l3", "c4"), False),
    ("lgpl-2.0", "full", ("l2", "c4"), False),
    ("agpl-3.0", "full", ("n1", "c4"), False),
    ("mpl-2.0", "full", ("m1", "m2"), True),
    ("isc", "full", ("g1", "g2"), True),
    ("0bsd", "full", ("g3", "g2"), True),
    ("unlicense", "full", ("h1", "h2"), True),
    *SHORT_RULES,
    ("apache-2.0", "text", ("b5",), True),
    ("gpl-3.0", "text", ("c7",), False),
    ("gpl-2.0", "text", ("c8",), False),
    ("bsd-2-clause", "notice", ("f6",), True),
    ("bsd-3-clause", "notice", ("f7",), True),
    ("lgpl-2.1", "text", ("l4",), False),
    ("lgpl-3.0", "text", ("l5",), False),
    ("agpl-3.0", "text", ("n2",), False),
    ("lgpl-2.1", "notice", ("l6",), False),
    ("lgpl-3.0", "notice", ("l7",), False),
    ("agpl-3.0", "notice", ("n3",), False),
    ("mpl-2.0", "notice", ("m3",), True),
    ("isc", "notice", ("g4",), True),
    ("0bsd", "notice", ("g5",), True),
    ("unlicense", "part", ("h1",), True),
    ("unlicense", "notice", ("h3",), True),
    ("cc0-1.0", "notice", ("d0",), True),
    *_cc_rules(),
)

#: Letters of a cue, at least, where a sentence has such a word.
CUE_CHARS = 7
#: The identifier of a reservation of rights, which a full licence text right after it takes back.
RESERVED = "e1"
#: The mark that no sentence goes across; a line end is the mark that it may go across.
_STOP = "\x01"


def marked(text: Column) -> Column:
    """Words in lower case, apart by one space, and the marks between them; a mark comes first and last."""
    steps = (
        (r"[;:]*[.!?][.!?;:]*\s+", _STOP),
        (r"[;:]+\s+", "\n"),
        (rf"([\n{_STOP}][^a-z0-9\n{_STOP}]*)(?:[a-z0-9]{{1,3}}\)|dnl|rem|o)[ \t]", "$1 "),  # marks of list items and of comments
        (rf"[^a-z0-9\n{_STOP}]+", " "),
        (r" ?\n ?\n[ \n]*", _STOP),
        (rf"[ \n]*{_STOP}[ \n{_STOP}]*", _STOP),
        (r" ?\n ?", "\n"),
    )
    whole = F.concat(F.lit("\n"), F.translate(F.lower(F.coalesce(text, F.lit(""))), _STOP, " "), F.lit("\n"))
    return reduce(lambda s, x: F.regexp_replace(s, *x), steps, whole)


def _pattern(sentence: str) -> str:
    """The sentence as a regular expression over marked text; a star inside it may hold a stop, as names do."""
    first, *more = sentence.split()
    word, gap = "[a-z0-9]+", rf"[ \n{_STOP}]"
    out = rf"(?:{word}[ \n]){{0,7}}{word}[ \n]" if first == "*" else rf"{first}[ \n]"
    out += "".join(rf"(?:{word}{gap}){{1,8}}" if w == "*" else rf"{w}[ \n]" for w in more)
    return out.removesuffix(r"[ \n]")


def cues(known: tuple) -> list[str]:
    """A few words of which every known sentence has one, long ones, so that most texts without a licence have none."""
    left, found = [{w for w in s.split() if w != "*"} for s, _ in known], []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            longest = max(map(len, words))
            for w in words:
                if len(w) >= min(CUE_CHARS, longest):
                    counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        found.append(best)
        left = [words for words in left if best not in words]
    return found


def identifiers(text: Column, known: tuple = SENTENCES) -> Column:
    """Identifiers of the known sentences of ``text``, in order; where two begin at one place, the longer is meant.

    A text is searched only if it holds a cue: marking parts words but makes none,
    so a sentence's words are in the text as they are.
    """
    if not known:
        return F.array().cast("array<string>")
    whole = F.lower(F.coalesce(text, F.lit("")))
    hint = reduce(lambda a, b: a | b, [F.contains(whole, F.lit(c)) for c in cues(known)])
    return F.when(hint, _identifiers(text, known)).otherwise(F.array().cast("array<string>"))


def _identifiers(text: Column, known: tuple) -> Column:
    longest = sorted(known, key=lambda x: (-len(x[0].split()), x[0]))
    first = [s for s, _ in longest if not s.startswith("* ")]
    star = [_pattern(s.removeprefix("* ")) for s, _ in longest if s.startswith("* ")]
    words = sorted({s.split()[0] for s in first})
    # alternatives are tried by their first words, and those that begin with a star by one star for all of them
    tries = [rf"(?:[a-z0-9]+[ \n]){{1,8}}?(?:{'|'.join(star)})"] if star else []
    tries += [rf"{w}\b(?:{'|'.join(_pattern(s)[len(w):] for s in first if s.split()[0] == w)})" for w in words]
    found = F.regexp_extract_all(marked(text), F.lit(rf"(?<=[\n{_STOP}])(?:{'|'.join(tries)})(?=[\n{_STOP}])"), F.lit(0))
    plain = [x for pair in known if "*" not in pair[0] for x in pair]
    exact = F.create_map(*map(F.lit, plain)) if plain else F.create_map().cast("map<string,string>")

    def identifier(s: Column) -> Column:
        stars = [F.when(s.rlike(f"^{_pattern(x)}$"), i) for x, i in longest if "*" in x]
        return F.coalesce(exact[F.translate(s, "\n", " ")], *stars)

    return F.transform(found, identifier)


HITS = "array<struct<rule:int,times:int>>"


def _matched(sequence: Column, rules: tuple) -> Column:
    """Numbers of the rules that match, in their order, and how often.

    ``sequence`` is a string of identifiers in brackets; what a rule has used becomes a bar.
    """
    table_of = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit("".join(f"({x})" for x in ids)).alias("wanted")) for n, (_, _, ids, _) in enumerate(rules)])
    start = F.struct(sequence.alias("left"), F.array().cast(HITS).alias("found"))

    def step(state: Column, rule: Column) -> Column:
        left = F.replace(state["left"], rule["wanted"], F.lit("|"))
        times = (F.length(state["left"]) - F.length(left)) / (F.length(rule["wanted"]) - 1)
        hit = F.array(F.struct(rule["rule"].alias("rule"), times.cast("int").alias("times")))
        taken = F.struct(left.alias("left"), F.concat(state["found"], hit).alias("found"))
        return F.when(F.contains(state["left"], rule["wanted"]), taken).otherwise(state)

    return F.aggregate(table_of, start, step, lambda s: s["found"])


def scan_licenses(docs: DataFrame, text: str = "text", known: tuple = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """``docs`` with license_ids (identifier sequence), matches and permissive.

    ``known`` and ``rules`` are tables like SENTENCES and RULES.  matches is an
    array of structs (license, form, times) in the order of the rules; a
    reservation of rights right before a full text counts as part of it.
    permissive is null where no rule matches, and else whether all matched
    licences permit reuse.  Null and empty texts match nothing; a text of any
    length is searched whole; a row's result depends on its own text alone, so
    repeated rows agree and an empty table stays empty.  Columns of ``docs`` that
    bear the three names give way; others may have any names and types.
    """
    ids = packed(docs, text=text).withColumn("license_ids", identifiers(F.col("text"), known))
    full = "|".join("".join(rf"\({x}\)" for x in r[2]) for r in rules if r[1] == "full")
    sequence = F.array_join(F.transform("license_ids", lambda i: F.concat(F.lit("("), i, F.lit(")"))), "")
    sequence = F.regexp_replace(sequence, rf"\({RESERVED}\)(?={full})", "") if full else sequence
    none = F.array().cast(HITS)
    some = ids.withColumn("hits", F.when(F.size("license_ids") > 0, _matched(sequence, rules)).otherwise(none) if rules else none)
    names = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("form"), F.lit(p).alias("permits")) for a, b, _, p in rules])
    if not rules:
        names = F.array().cast("array<struct<license:string,form:string,permits:boolean>>")
    matches = F.transform("hits", lambda h: F.struct(names[h["rule"]]["license"].alias("license"), names[h["rule"]]["form"].alias("form"), h["times"].alias("times")))
    permits = F.when(F.size("hits") > 0, F.forall("hits", lambda h: names[h["rule"]]["permits"]))
    told = some.withColumn("matches", matches).withColumn("permissive", permits)
    return unpacked(told, docs, "license_ids", "matches", "permissive")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["form"], m["times"].cast("string")))
    return found.select(
        "doc_id",
        F.array_join("license_ids", ",").alias("sentence_ids"),
        F.size("license_ids").cast("long").alias("n_sentences"),
        F.array_join(shown, ",").alias("licenses"),
        "permissive",
    )


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SHORT_SENTENCES)
    steps, left = [], "seq0"
    for n, (name, form, ids, permits) in enumerate(SHORT_RULES):
        wanted = "".join(f"({i})" for i in ids)
        steps.append(
            f"s{n} AS (SELECT *, replace({left}, '{wanted}', '|') AS seq{n + 1}, "
            f"CASE WHEN contains({left}, '{wanted}') THEN '{name}:{form}:' || "
            f"((length({left}) - length(replace({left}, '{wanted}', '|'))) // {len(wanted) - 1}) END AS m{n}, "
            f"CASE WHEN contains({left}, '{wanted}') THEN {str(permits).lower()} END AS p{n} FROM {f's{n - 1}' if n else 'seqs'})"
        )
        left = f"seq{n + 1}"
    last, every = len(SHORT_RULES) - 1, range(len(SHORT_RULES))
    return (
        r"WITH cut AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n|[.!?;:]+\s+|[.!?;:]+$')) AS s, "
        r"generate_subscripts(string_split_regex(coalesce(text, ''), '\n|[.!?;:]+\s+|[.!?;:]+$'), 1) AS pos FROM documents), "
        f"known AS (SELECT * FROM (VALUES {known}) v(sentence, id)), "
        "hits AS (SELECT doc_id, pos, id FROM cut JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), "
        "seqs AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS ids, count(*) AS n, "
        "string_agg('(' || id || ')', '' ORDER BY pos) AS seq0 FROM hits GROUP BY doc_id), "
        + ", ".join(steps)
        + " SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(n, 0) AS n_sentences, "
        f"concat_ws(',', {', '.join(f'm{n}' for n in every)}) AS licenses, "
        f"CASE WHEN concat_ws(',', {', '.join(f'm{n}' for n in every)}) <> '' THEN {' AND '.join(f'coalesce(p{n}, true)' for n in every)} END AS permissive "
        f"FROM documents d LEFT JOIN s{last} USING (doc_id)"
    )


ORACLE_SQL = _oracle()
