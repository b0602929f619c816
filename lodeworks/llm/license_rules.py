"""Licence scans by sentence rules.

Texts that can speak of a licence are normalised, and known licence sentences are looked up in them, on one line or
wrapped over several; a document's sequence of sentence identifiers is then matched against ordered rules, each of which
takes the identifiers it explains: all occurrences of them, so a notice that is repeated is explained by one rule.

Everything here is DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence without one of these is not normalised at all.
HINT = r"(?i)licen[cs]|rights reserved|rights are reserved|copyright|permission|warrant|redistribut|public domain|liable|merchantab|patent|spdx|cc0|creative commons"

#: identifier -> sentences as people write them; they are normalised like texts are.
SENTENCES: dict[str, tuple[str, ...]] = {
    "AllRights": ("All rights reserved.", "All rights are reserved."),
    "CCBYNCND40": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    "CCBYNCSA40": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    "CCBYNC40": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CCBYND40": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "CCBYSA40": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CCBYSA30": ("Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "SPDX-License-Identifier: CC-BY-SA-3.0"),
    "CCBY40": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC0": ("This work is dedicated to the public domain.", "Licensed under CC0 1.0.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL3": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPL version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL3Later": ("SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License, version 3 or later."),
    "GPL2": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "GPL2Later": ("SPDX-License-Identifier: GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPLText": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "GPLNoWarranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "GPLDetails": ("See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."),
    "GPLCopy": ("You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "You should have received a copy of the GNU Affero General Public License along with this program."),
    "LGPL21": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "LGPL3": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Apache2": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "ApacheCopy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"),
    "ApacheBasis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "ApacheSee": ("See the License for the specific language governing permissions and limitations under the License.",),
    "MITName": ("Released under the MIT License.", "Licensed under the MIT License.", "MIT License.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"),
    "MITGrant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "MITNotice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "MITAsIs": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "MITLiable": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "BSDGrant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSDSource": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "BSDBinary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "BSDEndorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSDName3": ("Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSDName2": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISCGrant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "ZlibGrant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"),
    "Boost": ("Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "MPL2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "EPL2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Proprietary": ("No part of this work may be reproduced without prior written permission.", "Redistribution is prohibited.", "This software is proprietary and confidential; no licence is granted."),
}

#: (licence, kind, identifiers in the order in which a text has them); a rule that fits takes all its identifiers.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("AGPL-3.0", "copyleft", ("AGPL3", "GPLNoWarranty", "GPLDetails", "GPLCopy")),
    ("AGPL-3.0", "copyleft", ("AGPL3", "GPLNoWarranty")),
    ("AGPL-3.0", "copyleft", ("AGPL3",)),
    ("LGPL-2.1", "copyleft", ("LGPL21", "GPLNoWarranty", "GPLDetails", "GPLCopy")),
    ("LGPL-2.1", "copyleft", ("LGPL21", "GPLNoWarranty")),
    ("LGPL-2.1", "copyleft", ("LGPL21",)),
    ("LGPL-3.0", "copyleft", ("LGPL3",)),
    ("GPL-2.0-or-later", "copyleft", ("GPL2Later", "GPLNoWarranty", "GPLDetails", "GPLCopy")),
    ("GPL-2.0-or-later", "copyleft", ("GPL2Later", "GPLNoWarranty")),
    ("GPL-2.0-or-later", "copyleft", ("GPL2Later",)),
    ("GPL-3.0-or-later", "copyleft", ("GPLText", "GPLNoWarranty", "GPLDetails", "GPLCopy")),
    ("GPL-3.0-or-later", "copyleft", ("GPLText", "GPLNoWarranty")),
    ("GPL-3.0-or-later", "copyleft", ("GPLText",)),
    ("GPL-3.0-or-later", "copyleft", ("GPL3Later",)),
    ("Apache-2.0", "permissive", ("Apache2", "ApacheCopy", "ApacheBasis", "ApacheSee")),
    ("Apache-2.0", "permissive", ("Apache2", "ApacheBasis")),
    ("MIT", "permissive", ("MITName", "MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    ("MIT", "permissive", ("MITName", "MITGrant", "MITNotice")),
    ("MIT", "permissive", ("MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    ("MIT", "permissive", ("MITGrant", "MITNotice")),
    ("BSD-3-Clause", "permissive", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-3-Clause", "permissive", ("BSDGrant", "BSDEndorse")),
    ("BSD-2-Clause", "permissive", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("BSD-2-Clause", "permissive", ("BSDGrant",)),
    ("BSD-3-Clause", "permissive", ("BSDName3",)),
    ("BSD-2-Clause", "permissive", ("BSDName2",)),
    ("ISC", "permissive", ("ISCGrant",)),
    ("Zlib", "permissive", ("ZlibGrant",)),
    ("BSL-1.0", "permissive", ("Boost",)),
    ("MPL-2.0", "copyleft", ("MPL2",)),
    ("EPL-2.0", "copyleft", ("EPL2",)),
    ("CC-BY-NC-ND-4.0", "noncommercial", ("CCBYNCND40",)),
    ("CC-BY-NC-SA-4.0", "noncommercial", ("CCBYNCSA40",)),
    ("CC-BY-NC-4.0", "noncommercial", ("CCBYNC40",)),
    ("CC-BY-ND-4.0", "copyleft", ("CCBYND40",)),
    ("CC-BY-SA-4.0", "copyleft", ("CCBYSA40",)),
    ("CC-BY-SA-3.0", "copyleft", ("CCBYSA30",)),
    ("CC-BY-4.0", "permissive", ("CCBY40",)),
    ("CC0-1.0", "permissive", ("CC0",)),
    ("Unlicense", "permissive", ("Unlicense",)),
    ("GPL-3.0", "copyleft", ("GPL3",)),
    ("GPL-2.0", "copyleft", ("GPL2",)),
    ("Apache-2.0", "permissive", ("Apache2",)),
    ("MIT", "permissive", ("MITName",)),
    ("Proprietary", "proprietary", ("AllRights", "Proprietary")),
    ("Proprietary", "proprietary", ("Proprietary",)),
    ("All-Rights-Reserved", "proprietary", ("AllRights",)),
)
KINDS = ("proprietary", "noncommercial", "copyleft", "permissive")


def normalise(sentence: str) -> str:
    """What licences() does to texts, for the known sentences."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def known_sentences() -> str:
    """In parts that are normalised and joined by \\n where a line ends, else by \\x01: a known sentence made of whole parts."""
    own = sorted({normalise(x) for known in SENTENCES.values() for x in known}, key=lambda x: (-len(x), x))
    return "(^|[\n\x01])(" + "|".join(x.replace(" ", "[ \n]") for x in own) + ")(?=[\n\x01]|\\z)"


def in_order(ids: Column, own: Column) -> Column:
    """Whether the array ids holds those of own in their order, others between them or not."""

    def step(at: Column, x: Column) -> Column:
        ahead = F.array_position(F.slice(ids, at + 1, F.size(ids)), x).cast("int")
        return F.when((at >= 0) & (ahead > 0), at + ahead).otherwise(-1)

    return F.aggregate(own, F.lit(0), step) > 0


def explained(ids: Column) -> Column:
    """(rules, left) of an array of identifiers: the numbers of the rules that fit, one after the other, and what they leave."""
    rules = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, own)).alias("own")) for k, (_, _, own) in enumerate(RULES)))
    state = lambda done, left: F.struct(done.alias("rules"), left.alias("left"))

    def step(now: Column, rule: Column) -> Column:
        rest = F.filter(now["left"], lambda x: ~F.array_contains(rule["own"], x))
        return F.when(in_order(now["left"], rule["own"]), state(F.concat(now["rules"], F.array(rule["k"])), rest)).otherwise(now)

    start = state(F.array().cast("array<int>"), ids)
    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step)).otherwise(start)


def licences(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text): sentence_ids and licences in order of the rules, as strings joined by
    commas and semicolons, kind (the strictest of KINDS, or none), n_unexplained (identifiers no rule took).

    A sentence starts and ends where a line or another sentence does. It may be wrapped, with comment signs before its
    lines, but has no blank line within.

    A rule fits if its identifiers come in its order, others between them or not.

    Null and empty texts have no licence. Rows that share a doc_id, null included, are one document, whose sentences are
    those of its rows by place; equal sentences at one place count once. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(normalise(x), k) for k, own in SENTENCES.items() for x in own], "norm string, sid string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ends = F.regexp_replace(F.translate(text, "\x01\x02\x03", "   "), "([.!?])(?:[ \t\r]+|\n)", "$1\x01")
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(ends), "[^a-z0-9\n\x01]+", " "), " *([\n\x01]) *", "$1"))
    parts = F.split(F.regexp_replace(norm, known_sentences(), "$1\x02$2\x03"), "[\n\x01]")
    most = max(normalise(x).count(" ") + 1 for own in SENTENCES.values() for x in own)  # each part of a sentence has a word
    whole = lambda i: F.substring_index(F.array_join(F.slice("_parts", i + 1, most), " "), "\x03", 1)
    starts = F.filter(F.transform("_parts", lambda s, i: F.when(s.startswith("\x02"), F.struct(i.alias("_at"), whole(i).alias("norm")))), lambda x: x.isNotNull())
    may = docs.where(text.rlike(HINT.replace(" ", "[^a-zA-Z0-9]+"))).select("doc_id", parts.alias("_parts")).select("doc_id", F.explode_outer(starts).alias("_s"))
    may = may.select("doc_id", "_s._at", F.translate("_s.norm", "\x02", "").alias("norm"))
    found = may.join(F.broadcast(known), "norm").select("doc_id", F.struct("_at", "sid").alias("_x"))
    rows = docs.select("doc_id", F.lit(None).cast(found.schema["_x"].dataType).alias("_x")).union(found)
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("_x")).alias("_x"))
    ids = F.transform("_x", lambda x: x["sid"])
    out = out.select("doc_id", ids.alias("_ids")).withColumn("_x", explained(F.col("_ids")))
    of = lambda values: F.transform("_x.rules", lambda k: F.get(F.array(*map(F.lit, values)), k))
    kind = F.lit("none")
    for want in reversed(KINDS):
        kind = F.when(F.array_contains(of([r[1] for r in RULES]), want), F.lit(want)).otherwise(kind)
    licences = F.array_join(F.array_distinct(of([r[0] for r in RULES])), ";")
    return out.select("doc_id", F.array_join("_ids", ",").alias("sentence_ids"), licences.alias("licences"), kind.alias("kind"), F.size("_x.left").cast("long").alias("n_unexplained"))
