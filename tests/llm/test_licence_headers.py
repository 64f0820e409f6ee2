"""Standard licence headers verbatim, bare and as comments."""

from __future__ import annotations

import duckdb
import pytest
from llm_fixtures import frame, odd_rows
from pyspark.sql import functions as F

from panelloom.llm import licences

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
AGPL = GPL3.replace("GNU General", "GNU Affero General")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
HEADERS = {"GPL3": GPL3, "GPL2": GPL2, "LGPL": LGPL, "AGPL": AGPL}


def scanned(spark, texts):
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in licences.licence_scan(frame(spark, rows)).collect()}
    return [found[i] for i in range(len(texts))]


def commented(text):
    return "".join(f" * {line}".rstrip() + "\n" for line in text.splitlines())


@pytest.mark.parametrize("change", [str, commented])
def test_standard_headers_are_found(spark, change):
    first = ["gpl_free3_later", "gpl_free2_later", "lgpl_free21_later", "agpl_free3_later"]
    named = ["GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later"]
    found = scanned(spark, [change(t) for t in HEADERS.values()])
    for row, sentence, licence in zip(found, first, named, strict=True):
        known = [i for i in row.sentences if i != "unknown"]
        assert known == [sentence, "gpl_warranty", "gpl_copy"]
        assert row.licences == [licence]
    for row in scanned(spark, [change(MPL), change(MPL).replace("v. ", "v.\n")]):
        assert row.licences == ["MPL-2.0"]


TOLD = {
    "This program is free software under version 2 of the GNU General Public License.": ["GPL"],
    "It is free software, under the GNU General Public License version 2 as published.": ["GPL-2.0"],
    "It is free software under the GNU Lesser General Public License.": ["LGPL"],
    "It is free software under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
    "// SPDX-License-Identifier: MIT\nint main;": ["MIT"],
    "/* SPDX-License-Identifier: LGPL-2.1-only */": ["LGPL-2.1"],
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Declared-SPDX"],
    "SPDX-License-Identifier: BSD-3-Clause.\nMore": ["BSD-3-Clause"],
    "Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/": ["Apache-2.0"],
    "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": ["LGPL-3.0"],
    "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991": ["GPL-2.0"],
}


def test_versions_titles_and_declared_values(spark):
    found = scanned(spark, list(TOLD))
    assert [r.licences for r in found] == list(TOLD.values())
    assert [r.declared for r in found if r.declared] == [
        ["MIT"], ["LGPL-2.1-only"], ["(MIT OR Apache-2.0)"], ["BSD-3-Clause."],
    ]


def test_unknown_sentences_between_known_ones(spark):
    text = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy. "
        "No licence fee is due. "
        "The above copyright notice and this permission notice shall be included in all copies. "
        "Warranty cards are kept elsewhere. The software is provided as is."
    )
    [row] = scanned(spark, [text])
    assert row.sentences == ["mit_grant", "unknown", "mit_notice", "unknown", "as_is"]
    assert row.licences == ["MIT"]


def test_sql_gives_the_same_for_headers_and_odd_texts(spark):
    texts = [*HEADERS.values(), MPL, *TOLD, *[t for _, t, _ in odd_rows()]]
    texts += [commented(t) for t in texts if t] + [t.replace("\n", "\r\n") for t in texts if t]
    texts += [MPL.replace("v. ", v) for v in ("v.\n", "v..  ", "Vers. ", "ver.\t\n", "v! ", "xv. ")]
    texts += [
        "See; \n the licence:\nCopyright\n\n(c) X\nAll rights\nreserved",
        "\r\r\nlicence\f\nmore \x0b\n\"quoted copyright\n<tag> licence\n - - dash licence",
        GPL3 + GPL2 + LGPL + AGPL + MPL,
    ]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    arrays = {c: F.concat_ws(" ", c) for c in ("sentences", "licences")}
    arrays["declared"] = F.concat_ws(", ", "declared")
    got = licences.licence_scan(docs).withColumns(arrays)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    told = con.execute(
        f"SELECT {', '.join(got.columns)} FROM ({licences.licence_sql()}) ORDER BY doc_id"
    ).fetchall()
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == told


def test_sentences_count_without_a_mark_in_the_raw_text(spark):
    got = scanned(
        spark,
        [
            "Text: CC-BY-SA 4.0",
            "This work is in Creative\nCommons Attribution 4.0.",
            "Placed in the public\ndomain.",
            "Plain CC0 here.",
            "The software is provided as is. In no event shall we be liable.",
        ],
    )
    assert [r.licences for r in got] == [["CC-BY-SA"], ["CC-BY"], ["Public-Domain"], ["CC0"], []]
    assert got[4].sentences == ["as_is", "no_liability"]


def test_a_line_that_begins_a_sentence_is_not_joined(spark):
    got = scanned(
        spark,
        ["SPDX-License-Identifier: MIT\nPermission is hereby granted, free of charge, to any\n"
         "person obtaining a copy\nThe above copyright notice and this permission notice shall\n"
         "be included in all copies\nCopyright 2020 A B\nAll rights reserved"],
    )
    assert [i for i in got[0].sentences if i != "unknown"] == [
        "spdx_mit", "mit_grant", "mit_notice", "all_rights",
    ]
