"""License scans: text compared with license templates by the Dice coefficient over word bigrams.

A document's units are its paragraphs (between blank lines) and its single
lines. A unit is normalised: lower case, every run of anything but letters
and digits one space, years and numbers kept. Its Dice coefficient with a
template is twice the number of common distinct bigrams over the sum of both
numbers. A coefficient of at least ``LEAST`` needs a size between
LEAST / (2 - LEAST) and (2 - LEAST) / LEAST times the template's: templates
outside these bounds are not compared. All is column code; nothing is
shuffled, and only the templates (``MOST_TEMPLATES`` at most) are in the plan.

Results for odd input: null text counts as empty and matches nothing; units
of one word have no bigram and match nothing; equal units of a text count
once; ties between templates go to the first name; repeated rows stay; an
empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
MOST_TEMPLATES = 200

#: Short notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/."),
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bounds(size: int, least: float = LEAST) -> tuple[float, float]:
    """Sizes that a unit may have to reach ``least`` with a template of this size."""
    return size * least / (2 - least), size * (2 - least) / least


def _unit_bigrams(unit: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1_000_000_000),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def matched(df: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """The columns ``keep`` of ``df``, and ``_found``: array of (dice, license, unit), the best template of each matching unit."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"over {MOST_TEMPLATES} templates")
    grams = {k: sorted(bigrams(normal_words(t))) for k, t in sorted(templates.items()) if len(normal_words(t)) > 1}
    longest = max((bounds(len(g), least)[1] for g in grams.values()), default=0)
    kind = "array<struct<dice:double,license:string,unit:string>>"
    t = F.coalesce(F.col(text), F.lit(""))
    # a unit has at least as many characters as bigrams, so too long ones need no words; short ones have no bigram
    units = F.filter(F.array_distinct(F.concat(F.split(t, r"\n[ \t\r]*\n"), F.split(t, "\n"))), lambda u: F.length(u) >= 3)
    sized = F.transform(units, lambda u: F.struct(u.alias("unit"), _unit_bigrams(u).alias("grams")))
    fits = F.filter(sized, lambda u: (F.size(u["grams"]) > 0) & (F.size(u["grams"]) <= longest))

    def dice(u: Column, name: str, own: list[str]) -> Column:
        low, high = bounds(len(own), least)
        n = F.size(u["grams"])
        common = F.size(F.array_intersect(u["grams"], F.array(*[F.lit(g) for g in own])))
        value = F.when((n >= low) & (n <= high), 2.0 * common / (n + len(own))).otherwise(F.lit(0.0))
        return F.struct((-value).alias("cost"), F.lit(name).alias("license"))

    best = F.transform(fits, lambda u: F.struct(u["unit"].alias("unit"), F.array_min(F.array(*[dice(u, k, g) for k, g in grams.items()])).alias("b")))
    good = F.filter(best, lambda x: -x["b"]["cost"] >= least)
    found = F.transform(good, lambda x: F.struct((-x["b"]["cost"]).alias("dice"), x["b"]["license"].alias("license"), x["unit"].alias("unit")))
    return df.select(*keep, (F.array_sort(found.cast(kind)) if grams else F.array().cast(kind)).alias("_found"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_units, licenses (names, comma-joined), best coefficient of every document."""
    got = matched(docs.select("doc_id", "text"), ["doc_id"], **options)
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["license"])))
    return got.select("doc_id", F.size("_found").cast("long").alias("n_units"), F.array_join(names, ",").alias("licenses"),
                      F.round(F.array_max(F.transform("_found", lambda x: x["dice"])), 6).alias("dice"))
