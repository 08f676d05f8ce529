"""License scan by sentence rules.

A text is cut into sentences (at blank lines and after ``.``, ``!``, ``?``, ``;``), which are normalised: lower case, and every
run of other characters than letters and digits is one space. Comment leaders are taken away. A line end may be white space
within a sentence or an end of one, so any whole lines of a sentence may be a known one, the longest first. Known sentences have identifiers; a rule is a sequence of identifiers.
A rule matches where its identifiers follow each other among the known sentences of a text (other sentences may stand between).
Rules are ordered: a match takes its sentences away from later rules, so the full grant of a licence is not also
reported as its notice line.

Only built-in expressions are used. Texts without any of the words in ``HINTS`` have no known sentence and are left
out early; every known sentence has one of them.

The SQL form reads line by line: it finds sentences that are not wrapped.

Null and empty texts have no licence. Results have one row per document row with a licence, so repeated rows repeat.
Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: known sentences, normalised, by identifier
SENTENCES = {
    "mit_notice": ["released under the mit license", "licensed under the mit license",
                   "this project is licensed under the mit license", "spdx license identifier mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation "
                  "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                  "permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial "
                      "portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the "
              "warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache_notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
                      "spdx license identifier apache 2 0"],
    "apache_use": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl3_notice": ["this work is licensed under the gnu general public license version 3",
                    "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"],
    "gpl_or_later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                     "public license as published by the free software foundation either version 3 of the license or at your "
                     "option any later version", "spdx license identifier gpl 3 0 or later"],
    "gpl_no_warranty": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd_redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided "
                           "that the following conditions are met"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission"],
    "cc_by_nc_notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0",
                        "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_by_notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0",
                     "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa_notice": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "all_rights": ["all rights reserved"],
}
# fixed values: ordered rules, licence and sequence of sentence identifiers
RULES = [
    ("MIT", ["mit_notice", "mit_grant", "mit_condition", "as_is"]),
    ("MIT", ["mit_grant", "mit_condition", "as_is"]),
    ("MIT", ["mit_grant", "mit_condition"]),
    ("Apache-2.0", ["apache_notice", "apache_use", "apache_copy"]),
    ("GPL-3.0-or-later", ["gpl_or_later", "gpl_no_warranty"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_redistribution"]),
    ("MIT", ["mit_notice"]),
    ("Apache-2.0", ["apache_notice"]),
    ("GPL-3.0-or-later", ["gpl_or_later"]),
    ("GPL-3.0-only", ["gpl3_notice"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_notice"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_notice"]),
    ("CC-BY-4.0", ["cc_by_notice"]),
    ("proprietary", ["all_rights"]),
]
HINTS = ["licens", "warrant", "permission", "copyright notice", "redistribut", "rights reserved"]
# sentence ends become line ends, then lines are cut; a full stop inside "2.0" is no end
SENTENCE_END = r"[.!?;]+([ \t\n\f\r]|\z)"
LINE_END = r"[\n\r]+"
# what stands before the text of a commented line
LEADER = r"(?im)^[ \t]*(?:[#*/%;>|!\"'<-]+|(?:rem|dnl)(?=[ \t\n\r]|\z))"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def known_sentences() -> list[tuple[str, str]]:
    """(sentence, identifier)"""
    return [(s, name) for name, variants in SENTENCES.items() for s in variants]


def rule_names() -> list[str]:
    """Licences in the order of their first rule."""
    return list(dict.fromkeys(name for name, _ in RULES))


def _marked(text: Column) -> Column:
    """Normalised words of a text, with a slash at line ends and a bar at sentence ends, blank lines and both ends."""
    text = F.translate(text, UPPER + "\x01\x02", LOWER + "  ")
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), LEADER, "")
    text = F.regexp_replace(F.regexp_replace(text, SENTENCE_END, "\x02"), r"\n[ \t\f]*(?:\n[ \t\f]*)+", "\x02")
    text = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("\x01")), "[^a-z0-9\x01\x02]+", " ")
    text = F.replace(F.replace(text, F.lit("\x01"), F.lit(" / ")), F.lit("\x02"), F.lit(" | "))
    return F.regexp_replace(F.concat(F.lit("| "), text, F.lit(" |")), " +", " ")


def licence_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, found): identifiers of the known sentences of each text in order, where there are any."""
    gap = r"[^A-Za-z0-9]+(?:(?:rem|dnl)[^A-Za-z0-9]+)?"
    hints = "(?i)" + "|".join(h.replace(" ", gap) for h in HINTS)
    some = documents.select("doc_id", "text").filter(F.col("text").rlike(hints))
    lookup = F.create_map(*[F.lit(x) for pair in known_sentences() for x in pair])
    longest = sorted((s for s, _ in known_sentences()), key=len, reverse=True)
    known = r"(?<=[|/] )(?:" + "|".join(s.replace(" ", "(?: /)? ") for s in longest) + ")(?= [|/])"
    found = F.regexp_extract_all(_marked(F.col("text")), F.lit(known), F.lit(0))
    names = F.transform(found, lambda s: F.try_element_at(lookup, F.replace(s, F.lit(" /"), F.lit(""))))
    return some.select("doc_id", F.array_compact(names).alias("found")).filter(F.size("found") > 0)


def licences(documents: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentences): licences, and known sentences in text order, comma-joined."""
    rows = licence_sentences(documents).withColumn("sentences", F.array_join("found", ","))
    # ",a,,b," lets a rule match whole identifiers only; a match becomes a bar, which no rule crosses
    rows = rows.withColumn("left", F.concat(F.lit(","), F.array_join("found", ",,"), F.lit(",")))
    hits: dict[str, Column] = {}
    for i, (name, sequence) in enumerate(RULES):
        wanted = F.lit("," + ",,".join(sequence) + ",")
        rows = rows.withColumn(f"_r{i}", F.contains("left", wanted)).withColumn(
            "left", F.replace("left", wanted, F.lit("|")))
        hits[name] = hits.get(name, F.lit(False)) | F.col(f"_r{i}")
    names = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]))
    return rows.select("doc_id", F.array_join(names, ",").alias("licenses"), "sentences").filter(
        F.col("licenses") != "")


def licences_sql() -> str:
    """The same for DuckDB, over a view ``documents``."""
    def quote(text):
        return "'" + text.replace("'", "''") + "'"

    known = ", ".join(f"({quote(s)}, {quote(n)})" for s, n in known_sentences())
    norm = f"trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    text = f"""WITH known(sentence, name) AS (VALUES {known}),
      cut AS (SELECT rid, doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM (
        SELECT row_number() OVER () AS rid, doc_id, string_split_regex(
          regexp_replace(text, {quote(SENTENCE_END)}, chr(10), 'g'), {quote(LINE_END)}) AS parts
        FROM documents WHERE regexp_matches(text, {quote("(?i)" + "|".join(HINTS))}))),
      found AS (SELECT rid, any_value(doc_id) AS doc_id, string_agg(name, ',' ORDER BY place) AS sentences,
          ',' || string_agg(name, ',,' ORDER BY place) || ',' AS rest
        FROM cut JOIN known ON {norm} = sentence GROUP BY rid)"""
    last, flags = "found", {}
    for i, (name, sequence) in enumerate(RULES):
        wanted = quote("," + ",,".join(sequence) + ",")
        text += (f", s{i} AS (SELECT * EXCLUDE (rest), contains(rest, {wanted}) AS r{i}, "
                 f"replace(rest, {wanted}, '|') AS rest FROM {last})")
        last = f"s{i}"
        flags.setdefault(name, []).append(f"r{i}")
    names = ", ".join(f"CASE WHEN {' OR '.join(f)} THEN {quote(n)} END" for n, f in flags.items())
    return (f"{text} SELECT doc_id, licenses, sentences FROM (SELECT doc_id, concat_ws(',', {names}) AS licenses, "
            f"sentences FROM {last}) WHERE licenses <> ''")
