"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, which are normalised and mapped to identifiers of known
licence sentences; unknown ones count if they may speak of a licence.  The sequence of identifiers is matched
against ordered rules.  A rule that matches uses up its identifiers, so a licence of
several sentences is not reported again by the rules for its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a text must hold (lower case) to be looked at more closely.
MARKS = ["licen", "copyright", "permission", "warrant", "redistribut", "public domain", "spdx"]
# Identifier of a known sentence, and its pattern over the normalised
# sentence.  The first that matches counts.
SENTENCES: list[tuple[str, str]] = [
    ("spdx_mit", r"\bspdx license identifier mit$"),
    ("spdx_isc", r"\bspdx license identifier isc$"),
    ("spdx_bsd3", r"\bspdx license identifier bsd 3 clause$"),
    ("spdx_bsd2", r"\bspdx license identifier bsd 2 clause$"),
    ("spdx_apache2", r"\bspdx license identifier apache 2.0$"),
    ("spdx_agpl3_later", r"\bspdx license identifier agpl 3.0 or later$"),
    ("spdx_agpl3", r"\bspdx license identifier agpl 3.0( only)?$"),
    ("spdx_lgpl3_later", r"\bspdx license identifier lgpl 3.0 or later$"),
    ("spdx_lgpl3", r"\bspdx license identifier lgpl 3.0( only)?$"),
    ("spdx_lgpl2_later", r"\bspdx license identifier lgpl 2.1 or later$"),
    ("spdx_lgpl2", r"\bspdx license identifier lgpl 2.1( only)?$"),
    ("spdx_gpl3_later", r"\bspdx license identifier gpl 3.0 or later$"),
    ("spdx_gpl3", r"\bspdx license identifier gpl 3.0( only)?$"),
    ("spdx_gpl2_later", r"\bspdx license identifier gpl 2.0 or later$"),
    ("spdx_gpl2", r"\bspdx license identifier gpl 2.0( only)?$"),
    ("spdx_mpl2", r"\bspdx license identifier mpl 2.0$"),
    ("spdx_cc0", r"\bspdx license identifier cc0 1.0$"),
    ("spdx", r"\bspdx license identifier \S"),
    ("mit_grant", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("mit_notice", r"\babove copyright notice and this permission notice shall be included\b"),
    ("isc_grant", r"\bpermission to use copy modify and or distribute this software for any purpose\b"),
    ("as_is", r"\bsoftware is provided as is\b"),
    ("no_liability", r"\bin no event shall\b.*\bliable\b"),
    ("bsd_grant", r"\bredistribution and use in source and binary forms\b.*\bpermitted\b"),
    ("bsd_source", r"\bredistributions of source code must retain\b"),
    ("bsd_binary", r"\bredistributions in binary form must reproduce\b"),
    ("bsd_endorse", r"\bneither the name of\b.*\bendorse or promote\b"),
    ("agpl_free3_later", r"\bis free software\b.*\baffero general public license\b.*\bversion 3\b.*\blater version\b"),
    ("agpl_free3", r"\bis free software\b.*\baffero general public license\b.*\bversion 3\b"),
    ("agpl_free", r"\bis free software\b.*\baffero general public license\b"),
    ("lgpl_free3_later", r"\bis free software\b.*\blesser general public license\b.*\bversion 3\b.*\blater version\b"),
    ("lgpl_free3", r"\bis free software\b.*\blesser general public license\b.*\bversion 3\b"),
    ("lgpl_free21_later", r"\bis free software\b.*\blesser general public license\b.*\bversion 2.1\b.*\blater version\b"),
    ("lgpl_free21", r"\bis free software\b.*\blesser general public license\b.*\bversion 2.1\b"),
    ("lgpl_free2_later", r"\bis free software\b.*\blibrary general public license\b.*\bversion 2\b.*\blater version\b"),
    ("lgpl_free", r"\bis free software\b.*\b(lesser|library) general public license\b"),
    ("gpl_free3_later", r"\bis free software\b.*\bgeneral public license\b.*\bversion 3\b.*\blater version\b"),
    ("gpl_free3", r"\bis free software\b.*\bgeneral public license\b.*\bversion 3\b"),
    ("gpl_free2_later", r"\bis free software\b.*\bgeneral public license\b.*\bversion 2\b.*\blater version\b"),
    ("gpl_free2", r"\bis free software\b.*\bgeneral public license\b.*\bversion 2\b"),
    ("gpl_free", r"\bis free software\b.*\bgeneral public license\b"),
    ("gpl_warranty", r"\bwithout any warranty\b.*\bmerchantability\b"),
    ("gpl_copy", r"\bshould have received a copy of the gnu\b"),
    ("agpl3_title", r"\bgnu affero general public license version 3 19 november 2007\b"),
    ("lgpl3_title", r"\bgnu lesser general public license version 3 29 june 2007\b"),
    ("lgpl2_title", r"\bgnu lesser general public license version 2.1 february 1999\b"),
    ("gpl3_title", r"\bgnu general public license version 3 29 june 2007\b"),
    ("gpl2_title", r"\bgnu general public license version 2 june 1991\b"),
    ("agpl3", r"\blicensed under the gnu affero general public license\b.*\b3\b"),
    ("lgpl3", r"\blicensed under the gnu lesser general public license\b.*\b3\b"),
    ("lgpl2", r"\blicensed under the gnu lesser general public license\b.*\b2\b"),
    ("gpl3_or_later", r"\blicensed under the gnu general public license version 3 or\b.*\blater\b"),
    ("gpl3", r"\blicensed under the gnu general public license\b.*\b3\b"),
    ("gpl2", r"\blicensed under the gnu general public license\b.*\b2\b"),
    ("gpl_any", r"\blicensed under the gnu general public license\b"),
    ("apache2", r"\blicensed under the apache license version 2"),
    ("apache2_title", r"\bapache license version 2.0 january 2004\b"),
    ("apache_copy", r"\bobtain a copy of the license at\b"),
    ("mpl2", r"\bmozilla public license\b.*\b2"),
    ("mit", r"\b(released|licensed|distributed|available) under the( terms of the)? mit license\b"),
    ("bsd", r"\b(released|licensed|distributed|available) under the( terms of the)? bsd license\b"),
    ("cc_by_nc_sa", r"\b(cc|creative commons) (by nc sa|attribution noncommercial sharealike)\b"),
    ("cc_by_nc_nd", r"\b(cc|creative commons) (by nc nd|attribution noncommercial noderivatives)\b"),
    ("cc_by_nc", r"\b(cc|creative commons) (by nc|attribution noncommercial)\b"),
    ("cc_by_sa", r"\b(cc|creative commons) (by sa|attribution sharealike)\b"),
    ("cc_by_nd", r"\b(cc|creative commons) (by nd|attribution noderivatives)\b"),
    ("cc_by", r"\b(cc|creative commons) (by|attribution)\b"),
    ("cc0", r"\b(cc0|creative commons zero)\b"),
    ("public_domain", r"\b(released|dedicated|placed) (in|to|into) the public domain\b"),
    ("all_rights", r"\ball rights reserved\b"),
]
# Ordered rules; a licence and the sequence of identifiers that tells it.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit_grant", "mit_notice", "as_is", "no_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("ISC", ["isc_grant", "as_is", "no_liability"]),
    ("ISC", ["isc_grant"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "as_is"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "as_is"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache2", "apache_copy"]),
    ("Apache-2.0", ["apache2"]),
    ("AGPL-3.0", ["agpl3"]),
    ("LGPL-3.0", ["lgpl3"]),
    ("LGPL-2.1", ["lgpl2"]),
    ("GPL-3.0-or-later", ["gpl3_or_later"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL-2.0", ["gpl2"]),
    ("GPL", ["gpl_any"]),
    ("MPL-2.0", ["mpl2"]),
    ("MIT", ["mit"]),
    ("BSD", ["bsd"]),
    ("CC-BY-NC-SA", ["cc_by_nc_sa"]),
    ("CC-BY-NC-ND", ["cc_by_nc_nd"]),
    ("CC-BY-NC", ["cc_by_nc"]),
    ("CC-BY-SA", ["cc_by_sa"]),
    ("CC-BY-ND", ["cc_by_nd"]),
    ("CC-BY", ["cc_by"]),
    ("CC0", ["cc0"]),
    ("Public-Domain", ["public_domain"]),
    ("Declared-SPDX", ["spdx"]),
    ("Proprietary", ["all_rights"]),
]
# Licences told by one sentence of their own: titles of whole texts and declared
# identifiers.  An expression of several is ``Declared-SPDX``; column ``declared`` has its words.
RULES += [
    ("Apache-2.0", ["apache2_title"]),
    ("AGPL-3.0", ["agpl3_title"]),
    ("LGPL-3.0", ["lgpl3_title"]),
    ("LGPL-2.1", ["lgpl2_title"]),
    ("GPL-3.0", ["gpl3_title"]),
    ("GPL-2.0", ["gpl2_title"]),
    ("MIT", ["spdx_mit"]),
    ("ISC", ["spdx_isc"]),
    ("BSD-3-Clause", ["spdx_bsd3"]),
    ("BSD-2-Clause", ["spdx_bsd2"]),
    ("Apache-2.0", ["spdx_apache2"]),
    ("AGPL-3.0-or-later", ["spdx_agpl3_later"]),
    ("AGPL-3.0", ["spdx_agpl3"]),
    ("LGPL-3.0-or-later", ["spdx_lgpl3_later"]),
    ("LGPL-3.0", ["spdx_lgpl3"]),
    ("LGPL-2.1-or-later", ["spdx_lgpl2_later"]),
    ("LGPL-2.1", ["spdx_lgpl2"]),
    ("GPL-3.0-or-later", ["spdx_gpl3_later"]),
    ("GPL-3.0", ["spdx_gpl3"]),
    ("GPL-2.0-or-later", ["spdx_gpl2_later"]),
    ("GPL-2.0", ["spdx_gpl2"]),
    ("MPL-2.0", ["spdx_mpl2"]),
    ("CC0", ["spdx_cc0"]),
]
# The first sentence of a GNU header, and its licence.
GNU = [
    ("AGPL-3.0-or-later", "agpl_free3_later"),
    ("AGPL-3.0", "agpl_free3"),
    ("AGPL", "agpl_free"),
    ("LGPL-3.0-or-later", "lgpl_free3_later"),
    ("LGPL-3.0", "lgpl_free3"),
    ("LGPL-2.1-or-later", "lgpl_free21_later"),
    ("LGPL-2.1", "lgpl_free21"),
    ("LGPL-2.0-or-later", "lgpl_free2_later"),
    ("LGPL", "lgpl_free"),
    ("GPL-3.0-or-later", "gpl_free3_later"),
    ("GPL-3.0", "gpl_free3"),
    ("GPL-2.0-or-later", "gpl_free2_later"),
    ("GPL-2.0", "gpl_free2"),
    ("GPL", "gpl_free"),
]
# The whole header first, so that it uses up the two sentences all GNU headers share.
RULES = [
    (name, [first, *rest])
    for rest in (["gpl_warranty", "gpl_copy"], ["gpl_warranty"], [])
    for name, first in GNU
] + RULES
# Single words of which every known sentence and every mark has one.  White space and signs
# between words do not matter to them, so they can be looked for in raw text.
KEYS = [
    "licen", "copyright", "permission", "warrant", "redistribut", "spdx", "domain", "commons",
    "cc", "rights", "provided", "liable", "endorse", "received",
]
# Capitals that begin a sentence of their own rather than go on with the line before.
BEGINS = (
    r"Copyright|SPDX|Permission|Licen[cs]ed|Released|Distributed|Available|Dedicated|Placed"
    r"|All rights|ALL RIGHTS|Redistribution|Neither|The above|This |THIS SOFTWARE|THE SOFTWARE IS"
    r"|IN NO EVENT"
)
# A line that does not end a sentence is joined to the next; after ';' and ':' only if that
# one goes on in lower case.
JOINED = (
    r"(?:(?<=[^.!?:;\s])|(?<=\b[Vv]\.)|(?<=\b[Vv]ers?\.)|(?<=[:;])(?=[ \t]*\r?\n[ \t#/*;%-]*[a-z]))"
    r"[ \t]*\r?\n[ \t]*[#/*;%-]*[ \t]*(?=[\"'(<]*[\p{L}\p{N}])(?!" + BEGINS + ")"
)
# Abbreviations of "version" end no sentence.
ENDS = r"(?<!\b[Vv])(?<!\b[Vv]er)(?<!\b[Vv]ers)[.!?]+[ \t]+|[.!?:;]*\r?\n"
# A line that declares an expression ends a sentence, and the expression as written.
DECLARING = r"(SPDX-License-Identifier:[^\r\n]*)"
DECLARED = (
    r"SPDX-License-Identifier:[ \t]*"
    r"([A-Za-z0-9.+()-]+(?:[ \t]+(?:OR|AND|WITH|or|and|with)[ \t]+[A-Za-z0-9.+()-]+)*)"
)
UNKNOWN = "unknown"


def normalised(sentence: Column) -> Column:
    """Lower case, British spelling made American, words apart by one space."""
    words = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    words = F.regexp_replace(words, r"\.( |$)", " ")
    words = F.regexp_replace(words, "licence", "license")
    return F.trim(F.regexp_replace(words, " +", " "))


def has_key(text: Column) -> Column:
    """Whether lower-case ``text`` holds any of the keys."""
    found = F.lit(False)
    for key in KEYS:
        found = found | text.contains(key)
    return found


def is_marked(text: Column) -> Column:
    """Whether lower-case ``text`` holds any of the marks."""
    found = F.lit(False)
    for mark in MARKS:
        found = found | text.contains(mark)
    return found | text.contains("creative commons") | text.contains("cc by") | text.contains(
        "rights reserved"
    )


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence; ``unknown`` where none matches."""
    out = None
    for name, pattern in SENTENCES:
        hit = sentence.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(UNKNOWN)


def matched_rules(sequence: Column) -> Column:
    """Licences, in rule order, whose rules match the identifiers ``sequence`` (array).

    Unknown sentences between known ones do not keep a rule from matching.
    """
    sequence = F.filter(sequence, lambda i: i != UNKNOWN)
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids"))
            for name, ids in RULES
        ]
    )
    start = F.struct(
        F.concat_ws("", F.transform(sequence, lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias(
            "rest"
        ),
        F.array().cast("array<string>").alias("found"),
    )

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["ids"], F.lit("#")))
            .otherwise(state["rest"])
            .alias("rest"),
            F.when(hit, F.array_append(state["found"], rule["name"]))
            .otherwise(state["found"])
            .alias("found"),
        )

    return F.array_distinct(F.aggregate(rules, start, apply, lambda s: s["found"]))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, sentences (array of identifiers in text order, known
    sentences and ``unknown`` ones that carry a mark), licences (array, rule order),
    declared (array of declared SPDX expressions as written), n_known, n_unknown.

    Null and empty texts have empty arrays.  Rows are judged each for itself, so repeated
    rows give repeated results; null ids stay null; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # Texts without a key, and sentences without one, cannot hold what is looked for.
    lines = F.regexp_replace("text", DECLARING, "$1.")
    cut = F.split(F.regexp_replace(lines, JOINED, " "), ENDS)
    parts = F.filter(F.transform(cut, normalised), has_key)
    told = F.transform(
        parts,
        lambda s: F.struct(identifier(s).alias("id"), is_marked(s).alias("marked")),
    )
    kept = F.filter(told, lambda t: (t["id"] != UNKNOWN) | t["marked"])
    none = F.array().cast("array<string>")
    found = slim.select(
        "doc_id",
        F.when(has_key(F.lower("text")), F.transform(kept, lambda t: t["id"]))
        .otherwise(none)
        .alias("sentences"),
        F.regexp_extract_all("text", F.lit(DECLARED), 1).alias("declared"),
    )
    known = F.size(F.filter("sentences", lambda i: i != UNKNOWN))
    return found.select(
        "doc_id",
        "sentences",
        F.when(F.size("sentences") > 0, matched_rules(F.col("sentences")))
        .otherwise(none)
        .alias("licences"),
        "declared",
        known.cast("long").alias("n_known"),
        (F.size("sentences") - known).cast("long").alias("n_unknown"),
    )


def licence_sql(table: str = "documents") -> str:
    """The scan in DuckDB SQL, arrays joined by blanks (``declared`` by ', ').

    Its patterns cannot look behind, so lines are split first and each is joined to the line
    before or not; the sign after an abbreviation of "version" is removed before sentences are
    cut.
    """

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def holds(x: str, words: list[str]) -> str:
        return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"

    def like(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {quoted(pattern)})"

    marks = [*MARKS, "creative commons", "cc by", "rights reserved"]
    before, start = "lines[i - 1]", r"^[ \t]*[#/*;%-]*[ \t]*"
    ends_open = r"[^.!?:; \t\n\x0B\f\r][ \t]*$"
    ends_version = r"\b[Vv](ers?)?\.[ \t]*$"
    word = r"""["'(<]*[\p{L}\p{N}]"""
    goes_on = (
        f"({like(before, ends_open)} OR {like(before, ends_version)}"
        f" OR ({like(before, '[:;][ \t]*$')} AND {like('l', '^[ \t#/*;%-]*[a-z]')}))"
        f" AND {like('l', start + word)} AND NOT {like('l', start + '(' + BEGINS + ')')}"
    )
    norm = (
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        "lower(s), '[^a-z0-9.]+', ' ', 'g'), '\\.( |$)', ' ', 'g'), 'licence', 'license', 'g'),"
        " ' +', ' ', 'g'))"
    )
    cases = " ".join(f"WHEN {like('s', p)} THEN {quoted(n)}" for n, p in SENTENCES)
    steps, prev = [], "seqs"
    for k, (name, ids) in enumerate(RULES):
        mark = quoted("".join(f"<{i}>" for i in ids))
        steps.append(
            f"r{k} AS (SELECT * EXCLUDE (rest, found), replace(rest, {mark}, '#') AS rest, "
            f"CASE WHEN contains(rest, {mark}) AND NOT list_contains(found, {quoted(name)}) "
            f"THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM {prev})"
        )
        prev = f"r{k}"
    return f"""WITH slim AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
lined AS (
  SELECT doc_id, text, CASE WHEN {holds('lower(text)', KEYS)} THEN
    string_split(replace(regexp_replace(text, {quoted(DECLARING)}, '\\1.', 'g'), chr(13) || chr(10), chr(10)), chr(10)) ELSE [] END AS lines FROM slim
),
joined AS (
  SELECT doc_id, text, coalesce(array_to_string(list_transform(lines, lambda l, i: CASE WHEN i = 1 THEN l
    WHEN {goes_on} THEN ' ' || l ELSE chr(10) || l END), ''), '') AS whole FROM lined
),
cut AS (
  SELECT doc_id, text, list_filter(list_transform(string_split_regex(
      regexp_replace(whole, '\\b([Vv](ers?)?)[.!?]([ \\t])', '\\1\\3', 'g'), '[.!?]+[ \\t]+|[.!?:;]*\\n'),
      lambda s: {norm}), lambda s: {holds('s', KEYS)}) AS parts
  FROM joined
),
told AS (
  SELECT doc_id, text, list_transform(parts, lambda s: CASE {cases}
    WHEN {holds('s', marks)} THEN '{UNKNOWN}' ELSE '' END) AS ids FROM cut
),
ids AS (SELECT doc_id, text, list_filter(ids, lambda i: i <> '') AS ids FROM told),
seqs AS (
  SELECT doc_id, text, ids, coalesce(array_to_string(list_transform(list_filter(ids,
    lambda i: i <> '{UNKNOWN}'), lambda i: '<' || i || '>'), ''), '') AS rest,
    CAST([] AS VARCHAR[]) AS found FROM ids
),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentences,
       coalesce(array_to_string(found, ' '), '') AS licences,
       coalesce(array_to_string(regexp_extract_all(text, {quoted(DECLARED)}, 1), ', '), '') AS declared,
       CAST(len(list_filter(ids, lambda i: i <> '{UNKNOWN}')) AS BIGINT) AS n_known,
       CAST(len(list_filter(ids, lambda i: i = '{UNKNOWN}')) AS BIGINT) AS n_unknown
FROM {prev}"""
