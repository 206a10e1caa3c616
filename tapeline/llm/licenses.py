"""Licence recognition by sentence rules, in DataFrame functions only.

Normalised sentences map to licence-sentence identifiers; a rule is an ordered list of identifiers, and a document carries the licence when the
identifiers found in it contain the rule's list without another known sentence in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence -> ordered alternatives; an alternative is a list of sentences, in normal form (lower-case words of letters and digits).
#: Notices that hold ';' or 'v.' are listed as SENTENCE_END splits them, and whole for texts that write a comma or no mark there.
RULES: dict[str, list[list[str]]] = {
    "Apache-2.0": [
        ["licensed under the apache license version 2 0"],
        ["licensed under the apache license version 2 0 the license"],
        ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may obtain a copy of the license at"],
        ["licensed under the apache license version 2 0 the license", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at"],
        ["spdx license identifier apache 2 0"],
    ],
    "MIT": [
        ["released under the mit license"],
        ["licensed under the mit license"],
        ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
         "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
        ["spdx license identifier mit"],
    ],
    "GPL-3.0": [
        ["this work is licensed under the gnu general public license version 3"],
        ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
         "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
        ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
         "this program is distributed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"],
        ["spdx license identifier gpl 3 0 only"],
        ["spdx license identifier gpl 3 0 or later"],
    ],
    "GPL-2.0": [
        ["this work is licensed under the gnu general public license version 2"],
        ["spdx license identifier gpl 2 0 only"],
        ["spdx license identifier gpl 2 0 or later"],
    ],
    "CC-BY-NC-4.0": [["licensed under cc by nc 4 0"], ["spdx license identifier cc by nc 4 0"]],
    "CC-BY-4.0": [["licensed under cc by 4 0"], ["spdx license identifier cc by 4 0"]],
    "CC-BY-SA-4.0": [["licensed under cc by sa 4 0"], ["spdx license identifier cc by sa 4 0"]],
    "BSD-3-Clause": [
        ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
         "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
         "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
        ["spdx license identifier bsd 3 clause"],
    ],
    "MPL-2.0": [
        ["this source code form is subject to the terms of the mozilla public license v 2 0"],
        ["this source code form is subject to the terms of the mozilla public license v", "2 0"],
        ["spdx license identifier mpl 2 0"],
    ],
}

#: sentence -> identifier, in the order of the rules
SENTENCES: dict[str, int] = {s: i + 1 for i, s in enumerate(dict.fromkeys(s for alts in RULES.values() for alt in alts for s in alt))}
#: A sentence ends at . ! ? or ; before white space or the end.
SENTENCE_END = "[.!?;]+(?:[ \\t\\r\\n]+|$)"
#: Lines that break a sentence, and paragraphs for texts whose sentences wrap over lines.
LINE_BREAK, PARAGRAPH = "\\n", "\\n[ \\t\\r]*\\n"


def normal(sentence: Column) -> Column:
    """Lower-case ASCII words of letters and digits, one space between them."""
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "), F.lit(" "))


def identifiers(text: Column, units: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    parts = F.filter(F.split(text, f"(?:{SENTENCE_END}|{units})", -1), lambda s: F.length(s) >= min(map(len, SENTENCES)))
    return F.filter(F.transform(parts, lambda s: F.try_element_at(known, normal(s))), lambda i: i.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses): recognised sentences and the licences whose rule they fulfil.

    Sentences are read twice, with each line end as a break and with paragraph breaks only (for wrapped licence texts). ``licenses`` are those of
    either reading; ``n_sentences`` and ``sentence_ids`` show the reading that finds more, the first on a tie. ``sentence_ids`` and ``licenses``
    are comma-joined, the latter sorted and distinct. Null and empty texts have 0 sentences and empty strings. Rows are independent, so repeated
    rows and null ids need no care, and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(F.struct(identifiers(text, LINE_BREAK).alias("lines"), identifiers(text, PARAGRAPH).alias("wrapped")))).alias("r"))
    ids = F.when(F.size("r.wrapped") > F.size("r.lines"), F.col("r.wrapped")).otherwise(F.col("r.lines"))
    joined = lambda i: F.array_join(i.cast("array<string>"), ",")
    chain = F.concat(F.lit(","), joined(F.col("r.lines")), F.lit(",|,"), joined(F.col("r.wrapped")), F.lit(","))  # no rule reaches over the bar
    found = both.select("doc_id", F.size(ids).cast("long").alias("n_sentences"), joined(ids).alias("sentence_ids"), chain.alias("chain"))
    holds = lambda alts: " or ".join(f"contains(chain, ',{','.join(str(SENTENCES[s]) for s in alt)},')" for alt in alts)
    named = [F.when(F.expr(holds(RULES[name])), F.lit(name)) for name in sorted(RULES)]
    return found.withColumn("licenses", F.concat_ws(",", *named)).drop("chain")
