"""Operator 7: licence scans by sentences and rules, in DataFrame functions only.

A text is cut into sentences; each is normalised (ASCII lower case, everything but letters and digits one
space) and mapped to the identifiers of the known licence sentences in it, or to ``?``. Known sentences start and
end with lines but can go over several, behind comment marks too. The sequence of identifiers is then matched against ordered rules: a rule that finds its identifiers in a row names its licence and takes
them out, so that a later rule can't use them again. Runs of unknown sentences count as one ``?``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences end at blank lines, and at these marks before white space.
END = r"([.!?;])[ \t]+"

#: Identifier -> pattern of the whole normalised sentence. The first that matches counts.
SENTENCES = {
    "SpdxMit": r"(?:.* )?spdx license identifier mit",
    "SpdxApache2": r"(?:.* )?spdx license identifier apache 2 0",
    "SpdxGpl2": r"(?:.* )?spdx license identifier gpl 2 0(?: only| or later)?",
    "SpdxGpl3": r"(?:.* )?spdx license identifier gpl 3 0(?: only| or later)?",
    "SpdxBsd3": r"(?:.* )?spdx license identifier bsd 3 clause",
    "SpdxBsd2": r"(?:.* )?spdx license identifier bsd 2 clause",
    "SpdxLgpl2": r"(?:.* )?spdx license identifier lgpl 2 1(?: only| or later)?",
    "SpdxLgpl3": r"(?:.* )?spdx license identifier lgpl 3 0(?: only| or later)?",
    "SpdxAgpl3": r"(?:.* )?spdx license identifier agpl 3 0(?: only| or later)?",
    "SpdxMpl2": r"(?:.* )?spdx license identifier mpl 2 0",
    "SpdxIsc": r"(?:.* )?spdx license identifier isc",
    "SpdxZlib": r"(?:.* )?spdx license identifier zlib",
    "SpdxBsl1": r"(?:.* )?spdx license identifier bsl 1 0",
    "SpdxEpl2": r"(?:.* )?spdx license identifier epl 2 0",
    "SpdxUnlicense": r"(?:.* )?spdx license identifier unlicense",
    "SpdxCc0": r"(?:.* )?spdx license identifier cc0 1 0",
    "MitNamed": r"(?:.* )?(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat|x11)(?: license)?",
    "MitGrant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*",
    "MitNotice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "AsIs": r"(?:the|this) software is provided (?:by .* )?as is .*",
    "Liability": r"in no event shall .* be liable for any .*",
    "IscGrant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*",
    "BslGrant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*",
    "ZlibGrant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely .*",
    "Unlicense": r"this is free and unencumbered software released into the public domain",
    "WtfplTitle": r"do what the fuck you want to public license",
    "BsdRedistribution": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": r"(?:1 )?redistributions of source code must retain the above copyright notice .*",
    "BsdBinary": r"(?:2 )?redistributions in binary form must reproduce the above copyright notice .*",
    "BsdEndorse": r"(?:3 )?neither the name of .* may be used to endorse or promote products .*",
    "BsdNamed3": r"(?:.* )?under (?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?",
    "BsdNamed2": r"(?:.* )?under (?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?",
    "BsdNamed": r"(?:.* )?under (?:the )?bsd(?: style)?(?: license)?",
    "Apache2Named": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?apache(?: software)? license(?: version)?(?: v)? ?2(?: 0)?(?: the license)?",
    "Apache2Condition": r"you may not use this file except in compliance with the license",
    "Apache2Copy": r"you may obtain a copy of the license at .*",
    "Apache2Basis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*",
    "AgplNamed3": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public license|agpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?(?: of the license)?(?: or .*)?",
    "LgplNamed3": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?(?: of the license)?(?: or .*)?",
    "LgplNamed2": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: [01])?(?: of the license)?(?: or .*)?",
    "GplNamed3": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?(?: of the license)?(?: or .*)?",
    "GplNamed2": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?(?: of the license)?(?: or .*)?",
    "GplNamed": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?",
    "GplHope": r"(?:this program|it) is distributed in the hope that it will be useful but without any warranty .*",
    "GplReceived": r"you should have received a copy of the gnu general public license along with .*",
    "MplNamed2": r"(?:.* )?(?:under|to) (?:the )?(?:terms of )?(?:the )?mozilla public license(?: version| v)? ?2 0",
    "EplNamed2": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?eclipse public license(?: version| v)? ?2 0",
    "EuplNamed": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?european union public licen[sc]e(?: version| v)?(?: ?1 [012])?",
    "CddlNamed": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?common development and distribution license(?: version| v)?(?: ?1 [01])?",
    "ArtisticNamed2": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?artistic license(?: version| v)? ?2 0",
    "OdblNamed": r"(?:.* )?under (?:the )?(?:terms of )?(?:the )?open (?:database|data commons open database) license(?: version| v)?(?: ?1 0)?",
    "CcByNcSa": r"(?:.* )?under (?:a |the )?(?:cc by nc sa|creative commons attribution noncommercial sharealike)(?: [0-9] [0-9])?(?: international| unported)?(?: license)?",
    "CcByNcNd": r"(?:.* )?under (?:a |the )?(?:cc by nc nd|creative commons attribution noncommercial noderivatives)(?: [0-9] [0-9])?(?: international| unported)?(?: license)?",
    "CcByNc": r"(?:.* )?under (?:a |the )?(?:cc by nc|creative commons attribution noncommercial)(?: [0-9] [0-9])?(?: international| unported)?(?: license)?",
    "CcBySa": r"(?:.* )?under (?:a |the )?(?:cc by sa|creative commons attribution sharealike)(?: [0-9] [0-9])?(?: international| unported)?(?: license)?",
    "CcByNd": r"(?:.* )?under (?:a |the )?(?:cc by nd|creative commons attribution noderivatives)(?: [0-9] [0-9])?(?: international| unported)?(?: license)?",
    "CcBy": r"(?:.* )?under (?:a |the )?(?:cc by|creative commons attribution)(?: [0-9] [0-9])?(?: international| unported)?(?: license)?",
    "Cc0": r"(?:.* )?(?:under|to) (?:a |the )?(?:cc0|creative commons zero)(?: [0-9] [0-9])?(?: universal)?(?: license)?",
    "PublicDomain": r"(?:this|the) .* (?:is|has been) (?:free and unencumbered software )?(?:released|dedicated|placed) (?:in|into|to) the public domain",
    "Reserved": r"(?:copyright .* )?all rights reserved",
    "Copyright": r"(?:copyright (?:c )?|c )[0-9]{4} .*",
}
#: (identifiers in a row, licence), tried in this order.
RULES = [
    (("MitGrant", "MitNotice", "AsIs", "Liability"), "MIT"),
    (("MitGrant", "MitNotice", "AsIs"), "MIT"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse", "AsIs", "Liability"), "BSD-3-Clause"),
    (("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("BsdRedistribution", "BsdSource", "BsdBinary", "AsIs", "Liability"), "BSD-2-Clause"),
    (("BsdRedistribution", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("IscGrant", "AsIs", "Liability"), "ISC"),
    (("IscGrant",), "ISC"),
    (("Apache2Named", "Apache2Condition", "Apache2Copy", "Apache2Basis"), "Apache-2.0"),
    (("Apache2Named", "Apache2Condition", "Apache2Copy"), "Apache-2.0"),
    (("GplNamed3", "GplHope", "GplReceived"), "GPL-3.0"),
    (("GplNamed2", "GplHope", "GplReceived"), "GPL-2.0"),
    (("SpdxMit",), "MIT"),
    (("SpdxApache2",), "Apache-2.0"),
    (("SpdxGpl2",), "GPL-2.0"),
    (("SpdxGpl3",), "GPL-3.0"),
    (("SpdxBsd3",), "BSD-3-Clause"),
    (("SpdxBsd2",), "BSD-2-Clause"),
    (("SpdxLgpl2",), "LGPL-2.1"),
    (("SpdxLgpl3",), "LGPL-3.0"),
    (("SpdxAgpl3",), "AGPL-3.0"),
    (("SpdxMpl2",), "MPL-2.0"),
    (("SpdxIsc",), "ISC"),
    (("SpdxZlib",), "Zlib"),
    (("SpdxBsl1",), "BSL-1.0"),
    (("SpdxEpl2",), "EPL-2.0"),
    (("SpdxUnlicense",), "Unlicense"),
    (("SpdxCc0",), "CC0-1.0"),
    (("BslGrant", "AsIs"), "BSL-1.0"),
    (("BslGrant",), "BSL-1.0"),
    (("ZlibGrant",), "Zlib"),
    (("Unlicense",), "Unlicense"),
    (("WtfplTitle",), "WTFPL"),
    (("EplNamed2",), "EPL-2.0"),
    (("EuplNamed",), "EUPL"),
    (("CddlNamed",), "CDDL"),
    (("ArtisticNamed2",), "Artistic-2.0"),
    (("OdblNamed",), "ODbL-1.0"),
    (("MitNamed",), "MIT"),
    (("MitGrant",), "MIT-like"),
    (("BsdNamed3",), "BSD-3-Clause"),
    (("BsdNamed2",), "BSD-2-Clause"),
    (("BsdNamed",), "BSD"),
    (("Apache2Named",), "Apache-2.0"),
    (("AgplNamed3",), "AGPL-3.0"),
    (("LgplNamed3",), "LGPL-3.0"),
    (("LgplNamed2",), "LGPL-2.1"),
    (("GplNamed3",), "GPL-3.0"),
    (("GplNamed2",), "GPL-2.0"),
    (("GplNamed",), "GPL"),
    (("MplNamed2",), "MPL-2.0"),
    (("CcByNcSa",), "CC-BY-NC-SA"),
    (("CcByNcNd",), "CC-BY-NC-ND"),
    (("CcByNc",), "CC-BY-NC"),
    (("CcBySa",), "CC-BY-SA"),
    (("CcByNd",), "CC-BY-ND"),
    (("CcBy",), "CC-BY"),
    (("Cc0",), "CC0-1.0"),
    (("PublicDomain",), "Public-Domain"),
    (("Copyright", "Reserved"), "All-Rights-Reserved"),
    (("Reserved",), "All-Rights-Reserved"),
]


def _pattern(ids: tuple[str, ...]) -> str:
    """The identifiers in a row, in a sequence where each stands between bars."""
    return "".join(f"<{i}>" for i in ids)


#: Each pattern has one of these wherever it matches; only normalised sentences with one are compared.
IMPLIED = r"licen[sc]|copyright|permission|reserved|warrant|as[ \n]is|liable|redistribut|endorse|(?:released|distributed|available|provided)[ \n]under|bsd|apache|gpl|general[ \n]public|mozilla|cc[ \n]by|public[ \n]domain|cc0|creative|(?<![^\n])c [0-9]{4}"
#: Identifiers that stand on one line.
ONE_LINE = ("Reserved", "Copyright")
#: Identifiers whose sentences go on after what is known of them.
OPEN = tuple(i for i, p in SENTENCES.items() if ".*" in p.removeprefix("(?:.* )?")[-6:] and i not in ONE_LINE)


def _over_lines(identifier: str, pattern: str) -> str:
    """The pattern for whole lines of a normalised sentence; what precedes or follows the known words ends with their first or last line."""
    start, rest = ("(?:[^\n<]* )?", pattern.removeprefix("(?:.* )?")) if pattern.startswith("(?:.* )?") else ("", pattern)
    if identifier in ONE_LINE:
        rest = rest.replace(".*", "[^\n<]*")
    else:
        tail = next((t for t in (".*", ".*)?") if rest.endswith(t)), "")
        rest = rest.removesuffix(tail).replace(".*", "[^<]*?").replace(" ", "[ \n]") + tail.replace(".*", "[^\n<]*")
    return f"(?<![^\n]){start}(?:{rest})(?![^\n])"


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_sentences (known licence sentences), sequence (identifiers in order) and licences (names found, sorted, comma-joined).

    Null and empty texts have none; null ids stay null. Very long texts are scanned whole, sentence by sentence. Repeated rows
    each get a row; an empty table gives an empty table; columns of other names are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lower = F.translate(text, _UPPER, _LOWER)
    out = docs.select(F.col(id_col).alias("id"), F.regexp_replace(lower, "\r\n?", "\n").alias("lower"))
    bare = F.regexp_replace("lower", r"(?<![^\n])[^a-z0-9\n]+", "")
    ended = F.regexp_replace(F.regexp_replace(bare, r"(?<![^\n])[0-9]{1,2}[.)][ \t]+", "\n"), END, "$1\n\n")
    plain = F.regexp_replace(F.regexp_replace(ended, r"[^a-z0-9\n]+", " "), " ?\n ?", "\n")
    parts = F.filter(F.transform(F.split(plain, "\n{2,}", -1), lambda s: F.trim(F.regexp_replace(s, r"^\n|\n$", ""))), lambda s: s != "")

    def known(s: Column) -> Column:
        x = s
        for i, p in SENTENCES.items():
            x = F.regexp_replace(x, _over_lines(i, p), f"<{i}>")
        x = F.regexp_replace(x, rf"(<(?:{'|'.join(OPEN)})>)(?:\n[^<\n]+)+", "$1")
        return F.when(s.rlike(IMPLIED), F.regexp_replace(F.regexp_replace(x, r"(?<![^\n])[^<\n]+", "<?>"), "\n", "")).otherwise(F.lit("<?>"))

    ids = F.regexp_replace(F.array_join(F.transform(parts, known), ""), r"(?:<\?>)+", "<?>")
    out = out.select("id", ids.alias("seq"))
    rules = F.array(*[F.struct(F.lit(_pattern(r)).alias("row"), F.lit(name).alias("name")) for r, name in RULES])
    start = F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("names"))

    def apply(acc: Column, rule: Column) -> Column:
        here = F.contains(acc["seq"], rule["row"])
        return F.struct(F.when(here, F.replace(acc["seq"], rule["row"], F.lit("<?>"))).otherwise(acc["seq"]).alias("seq"), F.when(here, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    names = F.when(F.col("seq").rlike("<[A-Za-z]"), F.aggregate(rules, start, apply)["names"]).otherwise(F.array().cast("array<string>"))
    only = F.filter(F.split(F.regexp_replace("seq", "^<|>$", ""), "><"), lambda s: (s != "?") & (s != ""))
    return out.select(F.col("id").alias(id_col), F.size(only).cast("long").alias("n_sentences"), F.array_join(only, ",").alias("sequence"), F.array_join(F.sort_array(F.array_distinct(names)), ",").alias("licences"))


def oracle(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same in DuckDB's SQL. Its patterns can't look behind or ahead, so each line gets line ends of its own, two between lines."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sub = lambda of, pattern, by: f"regexp_replace({of}, {q(pattern)}, {q(by)}, 'g')"
    lines = sub("translate(coalesce({c}, ''), '{u}', '{l}')".format(c=text_col, u=_UPPER, l=_LOWER), "\r\n?", "\n")
    bare = sub(f"chr(10) || {lines}", "\n[^a-z0-9\n]+", "\n")
    ended = sub(sub(bare, r"\n[0-9]{1,2}[.)][ \t]+", "\n\n"), END, "\\1\n\n")
    plain = f"substr({sub(sub(ended, r'[^a-z0-9' + chr(10) + ']+', ' '), ' ?\n ?', chr(10))}, 2)"
    parts = f"list_filter(list_transform(string_split_regex({plain}, '\\n{{2,}}'), lambda s: trim({sub('s', '^\n|\n$', '')})), lambda s: s <> '')"
    known = "chr(10) || replace(s, chr(10), chr(10) || chr(10)) || chr(10)"
    for i, p in SENTENCES.items():
        own = _over_lines(i, p).removeprefix("(?<![^\n])").removesuffix("(?![^\n])").replace("[ \n]", "(?: |\n\n)")
        known = sub(known, f"\n(?:{own})\n", f"\n<{i}>\n")
    known = sub(known, rf"(<(?:{'|'.join(OPEN)})>)\n(?:\n[^<\n]+\n)+", "\\1\n")
    known = f"replace({sub(known, chr(10) + '[^<' + chr(10) + ']+' + chr(10), '<?>')}, chr(10), '')"
    implied = IMPLIED.replace(r"(?<![^\n])", "\n")
    known = f"CASE WHEN regexp_matches(chr(10) || s, {q(implied)}) THEN {known} ELSE '<?>' END"
    seq = sub(f"array_to_string(list_transform({parts}, lambda s: {known}), '')", r"(?:<\?>)+", "<?>")
    body = f"SELECT {id_col}, seq AS s0, []::VARCHAR[] AS n0, seq FROM (SELECT {id_col}, {seq} AS seq FROM {table})"
    for k, (r, name) in enumerate(RULES):
        row = q(_pattern(r))
        body = f"SELECT {id_col}, seq, replace(s{k}, {row}, '<?>') AS s{k + 1}, CASE WHEN contains(s{k}, {row}) THEN list_append(n{k}, {q(name)}) ELSE n{k} END AS n{k + 1} FROM ({body})"
    only = "list_filter(string_split(regexp_replace(regexp_replace(seq, '^<', ''), '>$', ''), '><'), lambda s: s <> '?' AND s <> '')"
    return f"SELECT {id_col}, len({only})::BIGINT AS n_sentences, array_to_string({only}, ',') AS sequence, array_to_string(list_sort(list_distinct(n{len(RULES)})), ',') AS licences FROM ({body})"
