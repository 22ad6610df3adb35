"""License scans, with DataFrame functions only.

Texts and licence templates are normalised: ASCII letters lower-cased, all but letters and digits turned into single
spaces. A text's words are one sequence, across line breaks and comment marks, and its bigrams meet templates in an index
from bigrams to templates, of fixed size. A window of the text, from one bigram of a template to another, has c of the
template's b bigrams and u places whose bigram isn't the template's; its Dice coefficient is 2c / (c + u + b). Size
bounds leave out templates of which a text has too few bigrams within the longest window that could match. Of the windows
from each place where a run of the template's bigrams starts (or its first bigram stands) the best is taken, the longest
of equal ones, and of overlapping ones that with the greatest 2c - u - b (then the higher coefficient, the template first
by name, the earlier place). Templates are the statements below and the whole texts and notices in the folder
``licenses``; those of a single word are not found.

Null and empty texts, and texts of one word, match nothing. Very long texts are read whole. Repeated rows give repeated
results. Extra columns are ignored; a null id is carried through. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Public licence statements and the sentences that identify licence texts.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-short": "Released under the BSD License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def texts() -> dict[str, str]:
    """``TEMPLATES`` and the whole licence texts and notices."""
    return TEMPLATES | {f"{p.stem}-full": p.read_text() for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _split(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def _words(raw: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def scan(docs: DataFrame, id_column: str = "doc_id", percent: int = 80, templates: dict[str, str] | None = None) -> DataFrame:
    """Per licence passage of a whole text: id, first_word, last_word (from 0), license, dice. No two passages of a text overlap."""
    index = []
    for name, t in sorted((texts() if templates is None else templates).items()):
        w = _split(t)
        places = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        size = len(set(places))
        # bigrams a window has at least, and places it spans at most
        index += [(g, name, k, size, -(-size * percent // (200 - percent)), len(places) * (200 - percent) // percent) for k, g in enumerate(dict.fromkeys(places))]
    index = docs.sparkSession.createDataFrame(index, "gram string, license string, nr int, size int, need int, span int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    own = own.select("id", "row", F.explode(F.array(_words("text"))).alias("w")).where(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.concat(F.get("w", k - 1), F.lit(" "), F.get("w", k)))
    met = own.select("id", "row", F.size("w").alias("words"), F.posexplode(pairs).alias("at", "gram")).join(F.broadcast(index), "gram").where("words > need")
    before = F.lag("at").over(Window.partitionBy("row", "license", "nr").orderBy("at"))
    met = met.repartition("row", "license").withColumn("before", F.coalesce(before, F.lit(-1)))
    one = met.groupBy("row", "license").agg(F.first("id").alias("id"), F.first("size").alias("size"), F.first("need").alias("need"), F.first("span").alias("span"), F.array_sort(F.collect_list(F.struct("at", "before", "nr"))).alias("hits"))
    one = one.where("size(hits) >= need")
    at = lambda k: F.get("hits", k)["at"]
    starts = F.filter(
        F.sequence(F.lit(0), F.size("hits") - F.col("need")),
        lambda k: (at(k + F.col("need") - 1) - at(k) < F.col("span")) & ((k == 0) | (at(k - 1) < at(k) - 1) | (F.get("hits", k)["nr"] == 0)),
    )
    one = one.select("row", "license", "id", "size", "span", "hits", F.explode(starts).alias("k"))
    one = one.withColumn("s", at(F.col("k"))).withColumn("hits", F.expr("filter(slice(hits, k + 1, span), h -> h.at - s < span)"))
    # c: bigrams met so far, n: hits so far; the best window so far is kept as (dice, c, u, last place)
    best = F.expr(f"""aggregate(hits, named_struct('c', 0, 'n', 0, 'dice', 0D, 'gain', 0, 'e', -1), (a, h) ->
        transform(array(named_struct('c', a.c + int(h.before < s), 'n', a.n + 1)), x ->
            transform(array(h.at - s + 1 - x.n), u ->
                if(200 * x.c >= {int(percent)} * (x.c + u + size) AND 2D * x.c / (x.c + u + size) >= a.dice,
                   named_struct('c', x.c, 'n', x.n, 'dice', 2D * x.c / (x.c + u + size), 'gain', 2 * x.c - u - size, 'e', h.at),
                   named_struct('c', x.c, 'n', x.n, 'dice', a.dice, 'gain', a.gain, 'e', a.e)))[0])[0])""")
    found = one.select("row", "id", "license", "s", best.alias("b")).where("b.e >= 0")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("b.gain")).alias("loss"), (-F.col("b.dice")).alias("far"), "license", F.col("s").alias("first_word"), (F.col("b.e") + 1).alias("last_word"))))
    kept = F.expr("aggregate(ranked, slice(ranked, 1, 0), (a, p) -> if(exists(a, q -> q.first_word <= p.last_word AND p.first_word <= q.last_word), a, array_append(a, p)))")
    out = found.groupBy("row").agg(F.first("id").alias("id"), ranked.alias("ranked")).select("id", F.explode(kept).alias("p"))
    return out.select(F.col("id").alias(id_column), "p.first_word", "p.last_word", "p.license", (-F.col("p.far")).alias("dice"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(percent: int = 80, table: str = "documents", id_column: str = "doc_id") -> str:
    """The scan as DuckDB SQL."""
    normal = lambda c: f"list_filter(string_split(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    pairs = "list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])"
    return f"""
WITH RECURSIVE template(license, raw) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in sorted(texts().items()))}),
places AS (SELECT license, {pairs} AS p FROM (SELECT license, {normal("raw")} AS w FROM template)),
sizes AS (SELECT license, len(list_distinct(p)) AS size, (len(list_distinct(p)) * {percent} + {199 - percent}) // {200 - percent} AS need, len(p) * {200 - percent} // {percent} AS span FROM places),
idx AS (SELECT license, gram, size, need, span, row_number() OVER (PARTITION BY license ORDER BY first_at) = 1 AS leads FROM (SELECT license, gram, min(k) AS first_at FROM (SELECT license, unnest(p) AS gram, unnest(range(len(p))) AS k FROM places) GROUP BY ALL) JOIN sizes USING (license)),
own AS (SELECT row_number() OVER () AS rid, {id_column} AS id, {normal("coalesce(text, '')")} AS w FROM {table}),
grams AS (SELECT rid, len(w) AS words, unnest({pairs}) AS gram, unnest(range(len(w) - 1)) AS pos FROM own WHERE len(w) > 1),
hits AS (SELECT rid, license, pos, leads, size, need, span, coalesce(lag(pos) OVER (PARTITION BY rid, license, gram ORDER BY pos), -1) AS before FROM grams JOIN idx USING (gram) WHERE words > need),
starts AS (SELECT rid, license, pos AS s, size, span FROM (SELECT *, lead(pos, need::INT - 1) OVER h AS reach, lag(pos) OVER h AS last FROM hits WINDOW h AS (PARTITION BY rid, license ORDER BY pos)) WHERE reach - pos < span AND (last IS NULL OR last < pos - 1 OR leads)),
windows AS (SELECT rid, license, s, st.size, h.pos AS e, count(*) OVER x AS n, sum((before < s)::INT) OVER x AS c FROM starts st JOIN hits h USING (rid, license) WHERE h.pos >= s AND h.pos - s < st.span WINDOW x AS (PARTITION BY rid, license, s ORDER BY h.pos)),
best AS (SELECT rid, license, s AS first_word, e + 1 AS last_word, 2 * c::DOUBLE / (c + (e - s + 1 - n) + size) AS dice, 2 * c - (e - s + 1 - n) - size AS gain FROM windows WHERE 200 * c >= {percent} * (c + (e - s + 1 - n) + size) QUALIFY row_number() OVER (PARTITION BY rid, license, s ORDER BY dice DESC, e DESC) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY gain DESC, dice DESC, license, first_word, last_word) AS k FROM best),
kept AS (SELECT rid, k, [{{'a': first_word, 'b': last_word}}] AS seen, true AS keep FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.rid, r.k, CASE WHEN free THEN list_append(seen, {{'a': first_word, 'b': last_word}}) ELSE seen END, free
  FROM (SELECT r.*, t.seen, len(list_filter(t.seen, lambda q: q.a <= r.last_word AND r.first_word <= q.b)) = 0 AS free FROM kept t JOIN ranked r ON r.rid = t.rid AND r.k = t.k + 1) r)
SELECT id AS {id_column}, first_word::INT AS first_word, last_word::INT AS last_word, license, dice FROM kept JOIN ranked USING (rid, k) JOIN own USING (rid) WHERE keep
"""
