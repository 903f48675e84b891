"""The tables that the whole report stands on: listed once, built without methods that stay interpreted."""
from checks import lake
from touchline.session import COMPILED_METHOD
from touchline.sources import layers

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_tables_of_the_report(spark, monkeypatch):
    sf, limits, write = "/root/testdata/sf0.001", [], layers.write

    def watched(df, path, *args, **layout):
        limits.append(int(spark.conf.get(LIMIT)))
        write(df, path, *args, **layout)

    monkeypatch.setattr(layers, "write", watched)
    monkeypatch.setattr(lake, "_written", {})
    monkeypatch.setattr(lake, "_read", {})
    before = spark.conf.get(LIMIT)
    first = lake.matches(spark, sf)
    assert limits == [COMPILED_METHOD] and spark.conf.get(LIMIT) == before
    assert lake.matches(spark, sf) is first
