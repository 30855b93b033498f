"""License scans by sentence rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.llm.common import table

#: Normalised licence sentences (marks dropped, lower case) and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "licensed under the apache license version 2 0": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy-at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache2-basis",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-endorse",
    "licensed under cc by nc 4 0": "ccbync4-notice",
    "licensed under cc by 4 0": "ccby4-notice",
    "licensed under cc by sa 4 0": "ccbysa4-notice",
    "all rights reserved": "reserved",
}


#: Sentences of the licences' own texts and headers, whole; `<who>` stands for one to twelve words.
TEXTS = {
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-keep-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-no-liability",
    "apache license version 2 0 january 2004": "apache2-title",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may not use this work except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy-at",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2-copy-at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-grant",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "see the gnu general public license for more details": "gpl-details",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "if not see http www gnu org licenses": "gpl-see",
    "if not see https www gnu org licenses": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses": "gpl-copy",
    "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses": "gpl-copy",
    "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa": "gpl-copy",
    "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 59 temple place suite 330 boston ma 02111 1307 usa": "gpl-copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of <who> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of <who> nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "spdx license identifier mit": "mit-notice",
    "spdx license identifier apache 2 0": "apache2-notice",
    "spdx license identifier bsd 2 clause": "bsd2-notice",
    "spdx license identifier bsd 3 clause": "bsd3-notice",
    "spdx license identifier isc": "isc-notice",
    "spdx license identifier mpl 2 0": "mpl2-notice",
    "spdx license identifier gpl 2 0 only": "gpl2-notice",
    "spdx license identifier gpl 2 0 or later": "gpl2-notice",
    "spdx license identifier gpl 3 0 only": "gpl3-notice",
    "spdx license identifier gpl 3 0 or later": "gpl3-notice",
    "spdx license identifier lgpl 2 1 only": "lgpl21-notice",
    "spdx license identifier lgpl 2 1 or later": "lgpl21-notice",
    "spdx license identifier lgpl 3 0 only": "lgpl3-notice",
    "spdx license identifier lgpl 3 0 or later": "lgpl3-notice",
    "spdx license identifier agpl 3 0 only": "agpl3-notice",
    "spdx license identifier agpl 3 0 or later": "agpl3-notice",
    "spdx license identifier epl 2 0": "epl2-notice",
    "spdx license identifier cc0 1 0": "cc0-notice",
    "spdx license identifier unlicense": "unlicense-notice",
    "spdx license identifier zlib": "zlib-notice",
    "spdx license identifier bsl 1 0": "bsl1-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-no-liability",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "mozilla public license version 2 0": "mpl2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty": "lgpl-hope",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-hope",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "see the gnu affero general public license for more details": "agpl-details",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-no-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "boost software license version 1 0 august 17th 2003": "bsl1-title",
    "distributed under the boost software license version 1 0": "bsl1-notice",
    "eclipse public license v 2 0": "epl2-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-notice",
    "do what the fuck you want to public license": "wtfpl-title",
    "sil open font license version 1 1 26 february 2007": "ofl11-title",
    "this font software is licensed under the sil open font license version 1 1": "ofl11-notice",
    "the artistic license 2 0": "artistic2-title",
    "creative commons attribution 4 0 international public license": "ccby4-title",
    "creative commons attribution sharealike 4 0 international public license": "ccbysa4-title",
    "creative commons attribution noncommercial 4 0 international public license": "ccbync4-title",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4-notice",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd4-advertising",
    "microsoft public license ms pl": "mspl-title",
    "this software is provided by <who> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
}


@dataclass(frozen=True)
class Rule:
    """A licence that is recognised where these sentences follow each other among a text's licence sentences."""

    licence: str
    sentences: tuple[str, ...]


#: The first rule listed wins where several start at one sentence, so longer ones stand before what they contain.
RULES = [
    Rule("MIT", ("mit-grant", "mit-keep-notice", "as-is")),
    Rule("MIT", ("mit-grant", "mit-keep-notice")),
    Rule("MIT", ("mit-notice",)),
    Rule("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy-at", "apache2-basis")),
    Rule("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy-at")),
    Rule("Apache-2.0", ("apache2-notice",)),
    Rule("GPL-3.0", ("gpl3-notice", "gpl-grant", "gpl-hope", "gpl-copy")),
    Rule("GPL-3.0", ("gpl3-notice",)),
    Rule("GPL", ("gpl-grant", "gpl-hope", "gpl-copy")),
    Rule("GPL", ("gpl-grant",)),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("CC-BY-NC-4.0", ("ccbync4-notice",)),
    Rule("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    Rule("CC-BY-4.0", ("ccby4-notice",)),
]

#: Rules over the sentences of whole texts. A text that the rule above would name less exactly stands before it.
TEXT_RULES = [
    Rule("MIT", ("mit-title", "mit-grant", "mit-keep-notice", "as-is", "mit-no-liability")),
    Rule("MIT", ("mit-grant", "mit-keep-notice", "as-is", "mit-no-liability")),
    Rule("MIT", ("mit-title", "mit-grant", "mit-keep-notice")),
    Rule("MIT", ("mit-keep-notice", "as-is", "mit-no-liability")),
    Rule("MIT", ("mit-keep-notice", "as-is")),
    Rule("MIT", ("mit-grant",)),
    Rule("MIT", ("mit-title",)),
    Rule("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy-at", "apache2-basis", "apache2-see")),
    Rule("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-basis", "apache2-see")),
    Rule("Apache-2.0", ("apache2-notice", "apache2-compliance")),
    Rule("Apache-2.0", ("apache2-title",)),
    *(Rule(f"GPL-{v}.0", (f"gpl{v}-grant", *rest)) for v in (3, 2) for rest in (("gpl-hope", "gpl-implied", "gpl-details", "gpl-copy", "gpl-see"), ("gpl-hope", "gpl-details", "gpl-copy", "gpl-see"), ("gpl-hope", "gpl-implied", "gpl-details", "gpl-copy"), ("gpl-hope", "gpl-details", "gpl-copy"), ("gpl-hope", "gpl-copy"), ("gpl-hope",), ())),
    Rule("GPL-3.0", ("gpl3-title",)),
    Rule("GPL-2.0", ("gpl2-title",)),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    Rule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd4-advertising", "bsd-endorse", "bsd-as-is")),
    Rule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd4-advertising", "bsd-endorse")),
    Rule("ISC", ("isc-grant", "isc-as-is", "isc-no-liability")),
    Rule("ISC", ("isc-grant",)),
    Rule("0BSD", ("0bsd-grant", "isc-as-is", "isc-no-liability")),
    Rule("0BSD", ("0bsd-grant",)),
    Rule("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    *(Rule(f"LGPL-{name}", (f"lgpl{v}-grant", *rest)) for v, name in (("3", "3.0"), ("21", "2.1")) for hope in ("lgpl-hope", "gpl-hope") for rest in ((hope, "gpl-implied", "lgpl-details"), (hope, "lgpl-details"), (hope,))),
    *(Rule("AGPL-3.0", ("agpl3-grant", *rest)) for rest in (("gpl-hope", "gpl-implied", "agpl-details"), ("gpl-hope", "agpl-details"), ())),
    *(Rule(f"LGPL-{name}", (f"lgpl{v}-grant",)) for v, name in (("3", "3.0"), ("21", "2.1"))),
    Rule("Unlicense", ("unlicense-notice", "unlicense-grant")),
    Rule("Zlib", ("zlib-as-is", "zlib-no-liability", "zlib-grant")),
    # a title or a notice alone
    *(
        Rule(licence, (sentence,))
        for licence, sentence in {
            "BSD-2-Clause": "bsd2-notice", "BSD-3-Clause": "bsd3-notice", "ISC": "isc-notice", "LGPL-2.1": "lgpl21-notice", "LGPL-3.0": "lgpl3-notice", "AGPL-3.0": "agpl3-notice", "EPL-2.0": "epl2-notice",
            "CC0-1.0": "cc0-notice", "Unlicense": "unlicense-notice", "Zlib": "zlib-notice", "BSL-1.0": "bsl1-notice", "GPL-2.0": "gpl2-notice", "WTFPL": "wtfpl-title", "OFL-1.1": "ofl11-notice", "Artistic-2.0": "artistic2-title",
            "CC-BY-4.0": "ccby4-title", "CC-BY-SA-4.0": "ccbysa4-title", "CC-BY-NC-4.0": "ccbync4-title", "MS-PL": "mspl-title",
        }.items()
    ),
    *(Rule(licence, (sentence,)) for licence, sentence in (("MPL-2.0", "mpl2-notice"), ("MPL-2.0", "mpl2-subject"), ("MPL-2.0", "mpl2-title"), ("LGPL-2.1", "lgpl21-title"), ("LGPL-3.0", "lgpl3-title"), ("AGPL-3.0", "agpl3-title"), ("BSL-1.0", "bsl1-title"), ("EPL-2.0", "epl2-title"), ("OFL-1.1", "ofl11-title"))),
]
#: Rules of both kinds, more sentences first.
ALL_RULES = sorted([*RULES, *TEXT_RULES, Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"))], key=lambda r: -len(r.sentences))
ALL_SENTENCES = SENTENCES | TEXTS

#: Ends a sentence: a full stop, colon, semicolon, exclamation or question mark before white space or the end. A line break may end one or be white space inside it.
_END = r"[.:;!?]+(?=\s|$)"
#: Parts of single words, one of which every listed sentence has; a text without any has no sentence, however it is broken or marked.
_CUES = ("licen", "permi", "copyright", "distribut", "warrant", "reserved", "software", "merchantability", "general")
#: What a text becomes before sentences are looked up: words with single spaces, these where a mark ends a sentence and where a line breaks.
_STOP, _LINE = "\ue000", "\ue001"


def _sentence_pattern() -> str:
    """One alternation of all sentences, longer ones first. A line may break between any words; in the licences' own texts marks may stand there (`free software: you can`) and a number before."""
    own = sorted(TEXTS, key=len, reverse=True)
    own = [rf"[ {_STOP}{_LINE}]+".join(rf"\w+(?:[ {_LINE}]+\w+){{0,11}}?" if w == "<who>" else w for w in s.split(" ")) for s in own]
    short = [s.replace(" ", f"[ {_LINE}]+") for s in sorted(SENTENCES, key=len, reverse=True)]
    return rf"(?<=[{_STOP}{_LINE}] )(?:(?:\d{{1,2}} )?(?:{'|'.join(own)})|{'|'.join(short)})(?= [{_STOP}{_LINE}])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in order. A sentence may be wrapped over lines, each with comment marks, or be a whole line without a full stop."""
    known = F.create_map(*(F.lit(x) for pair in ALL_SENTENCES.items() if "<who>" not in pair[0] for x in pair))
    low = F.lower(text)
    flat = F.regexp_replace(F.regexp_replace(F.translate(low, _STOP + _LINE, "  "), _END, _STOP), r"\n", _LINE)
    flat = F.regexp_replace(flat, rf"[^\p{{L}}\p{{N}}{_STOP}{_LINE}]+", " ")
    flat = F.concat(F.lit(_STOP + " "), F.trim(F.regexp_replace(flat, f" *([{_STOP}{_LINE}]) *", " $1 ")), F.lit(" " + _STOP))
    hits = F.regexp_extract_all(flat, F.lit(f"({_sentence_pattern()})"), F.lit(1))
    slots = [(s.split("<who>"), i) for s, i in TEXTS.items() if "<who>" in s]

    def name(hit: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(hit, f"[ {_STOP}{_LINE}]+", " "), r"^\d+ ", "")
        found = F.element_at(known, plain)
        for (head, tail), i in slots:
            found = F.coalesce(found, F.when(F.startswith(plain, F.lit(head)) & F.endswith(plain, F.lit(tail)), F.lit(i)))
        return found

    any_cue = F.greatest(*(F.contains(low, F.lit(c)) for c in _CUES))
    return F.when(any_cue, F.filter(F.transform(hits, name), lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with at least one known licence sentence: doc_id, sentences (identifiers in text order), licences (in order of
    appearance, repeats kept) and unmatched (how many of the sentences no rule used).

    docs: doc_id, text; other columns are not read. Null and empty texts have no sentences and so no row; repeated rows each have theirs; an
    empty table gives an empty result. Rules are matched left to right without overlap, the first listed one first. All of it is one
    narrow projection: texts are not shuffled and the sentence table is a literal in the plan.
    """
    found = docs.select("doc_id", sentence_ids(F.coalesce("text", F.lit(""))).alias("sentences")).where(F.size("sentences") > 0)
    # one letter for each sentence makes a sequence a string and a rule list one alternation
    names = list(dict.fromkeys(ALL_SENTENCES.values()))
    letter = {n: chr(0x4E00 + k) for k, n in enumerate(names)}
    code = F.array_join(F.transform("sentences", lambda s: F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, letter[n]))), s)), "")
    pattern = "|".join("".join(letter[s] for s in r.sentences) for r in ALL_RULES)
    licence = F.create_map(*(F.lit(x) for r in ALL_RULES for x in ("".join(letter[s] for s in r.sentences), r.licence)))
    hits = found.select("*", F.expr("size(sentences)").alias("n"), F.regexp_extract_all(code, F.lit(f"({pattern})"), F.lit(1)).alias("hits"))
    used = F.aggregate("hits", F.lit(0), lambda a, h: a + F.length(h))
    return hits.select("doc_id", "sentences", F.transform("hits", lambda h: F.element_at(licence, h)).alias("licences"), (F.col("n") - used).alias("unmatched"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and sentence identifiers joined by commas."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"), F.col("unmatched").cast("int").alias("unmatched"))


def _oracle() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    names = list(dict.fromkeys(SENTENCES.values()))
    letters = ", ".join(f"('{n}', '{chr(0x4E00 + k)}')" for k, n in enumerate(names))
    letter = {n: chr(0x4E00 + k) for k, n in enumerate(names)}
    rules = ", ".join(f"('{''.join(letter[s] for s in r.sentences)}', '{r.licence}')" for r in RULES)
    pattern = "|".join("".join(letter[s] for s in r.sentences) for r in RULES)
    return rf"""
WITH known(sentence, id) AS (VALUES {values}), letters(id, letter) AS (VALUES {letters}), rules(code, licence) AS (VALUES {rules}),
parts AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '\n|[.:;!?]+(?:\s|$)') AS a FROM documents),
flat AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS pos FROM parts),
ids AS (SELECT doc_id, pos, k.id, l.letter FROM flat JOIN known k ON trim(regexp_replace(s, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) = k.sentence JOIN letters l ON l.id = k.id),
seq AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS sentences, count(*) AS n, regexp_extract_all(string_agg(letter, '' ORDER BY pos), '{pattern}') AS hits FROM ids GROUP BY doc_id)
SELECT doc_id, sentences, array_to_string(list_transform(hits, lambda h: (list_filter([{', '.join(f"'{''.join(letter[s] for s in r.sentences)}={r.licence}'" for r in RULES)}], lambda x: starts_with(x, h || '='))[1])[length(h) + 2:]), ',') AS licences,
  CAST(n - coalesce(list_sum(list_transform(hits, lambda h: length(h))), 0) AS INTEGER) AS unmatched FROM seq
"""


ORACLE = _oracle()
