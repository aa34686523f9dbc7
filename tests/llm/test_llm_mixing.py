import pytest
from pyspark.sql import functions as F

from compare import connect
from lagwise.llm import licenses, queries, raking
from llm_data import assert_same_as_sql, empty_documents, odd_documents, odd_rows, prose


@pytest.mark.parametrize("name", ["op5_raking", "op10_licenses"])
def test_matches_sql_without_python(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().toString()
    assert not [word for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop") if word in plan]
    assert_same_as_sql(df, connect(folder), queries.ORACLE[name])


def test_marginals_reach_given_targets(spark):
    rows = [(k, prose(k, 40 + k % 9) + ("\nx" if k % 3 else ""), "en" if k % 5 else "de", f"s{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"article": 0.7, "note": 0.3}}
    topic = F.when(F.col("text").contains("\n"), "article").otherwise("note")
    found = raking.mixed(df, topic=topic, targets=targets, keep=0.1, rounds=40)
    weights = found.withColumn("w", F.col("probability") * (F.size(F.split("text", r"\s+")) + 1))
    total = weights.agg(F.sum("w")).first()[0]
    for name in ("source", "lang", "topic"):
        for r in weights.groupBy(name).agg(F.sum("w").alias("w")).collect():
            assert r.w / total == pytest.approx(targets[name][r[name]], abs=1e-6)
    tokens = weights.agg(F.sum(F.size(F.split("text", r"\s+")) + 1)).first()[0]
    assert total == pytest.approx(0.1 * tokens)
    assert found.where("kept").count() == pytest.approx(found.agg(F.sum("probability")).first()[0], abs=30)


def test_odd_rows_of_both(spark):
    df = odd_documents(spark)
    found = raking.mixed(df)
    assert len(found.collect()) == len(odd_rows()) and all(0 < r.probability <= 1 for r in found.collect())
    assert raking.sampled(df).columns == df.columns
    assert raking.mixed(empty_documents(spark)).collect() == [] and raking.sampled(empty_documents(spark)).collect() == []
    assert not any(r.licenses for r in licenses.scan(df).collect()) and licenses.scan(empty_documents(spark)).collect() == []


def test_rules_ask_for_order(spark):
    grant = next(s for s, i in licenses.SENTENCES.items() if i == "mit-grant").capitalize() + "."
    keep = next(s for s, i in licenses.SENTENCES.items() if i == "mit-keep-notice").upper() + "!"
    texts = [f"{grant} In between. {keep}", f"{keep} {grant}", "Intro.\nLicensed under CC BY-NC 4.0.\nEnd", "Released under the  MIT License", "no LICENSE here."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [found[k].licenses for k in range(5)] == [["MIT"], [], ["CC-BY-NC-4.0"], ["MIT"], []]
    assert [(s.place, s.id) for s in found[0].license_sentences] == [(0, "mit-grant"), (2, "mit-keep-notice")]
    import re

    assert all(re.search(licenses.SIGNAL, s) for s in licenses.SENTENCES)


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
""",
    "BSD-2-Clause": """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "ISC": """Copyright (c) 2020, Some One
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License"); you may not
// use this file except in compliance with the License. You may obtain a copy
""",
}
WRAPPED["BSD-3-Clause"] = WRAPPED["BSD-2-Clause"] + """
3. Neither the name of Some One nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_wrapped_licences_are_known(spark):
    texts = {**WRAPPED, "MIT ": "This project is licensed under the\nMIT License\nand not\n\nlicensed under the\n\napache license version 2.0"}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    found = {r.doc_id: r for r in licenses.scan(df.repartition(2)).collect()}
    assert {k: r.licenses for k, r in found.items()} == {k: [k.strip()] for k in texts}
    df = spark.createDataFrame([(k, t.replace("\n", "\r\n")) for k, t in WRAPPED.items()], "doc_id string, text string")
    assert {r.doc_id: r.licenses for r in licenses.scan(df).collect()} == {k: [k] for k in WRAPPED}
    both = spark.createDataFrame([(WRAPPED["BSD-2-Clause"] + WRAPPED["BSD-3-Clause"],)], "text string")
    assert licenses.scan(both).first().licenses == ["BSD-2-Clause", "BSD-3-Clause"]
