from pyspark.sql import functions as F

from codeloom.functions import ids

#: Values for the root /r.
REPO = "faf016d32c4c346fb3a1a9205cd02d25c861f83b665c6f8e2cc722e25241639e"
PROJECT = "caa5a4acaf2576623cc8ccd7b3179cd35f37720431fb7a563e3df5e564db454d"
WORKTREE = "c8312a4b44a5ba50f4ef854014df140009b994d9f8cc5ee285ff98493ad759b3"
SCOPE = "a3fd650ddf424b493af84bbeb0a7ebe69c4f67a371b2ed7f302bf7ff73618102"
FILE = "83675609e7ec391a04620c81d6acbc28115efb200cf2cbe714b2cfdc98c96eab"
SYMBOL = "a5a996e580b11b1ce99f4e50b9e6c6b5ab09d7f3e1eba980abe9099db4314599"
IMPORT = "c6e27da1e976321908aeef254c0377b23c73cd916c612927ddadb473a72b5d2e"
CHUNK = "250e7e87e155f660b11b88c7ac2e7db4254f8bfb0c984088eac1719b671cbda9"
TARGET = "50ec1980f25be550e6fa25b3ee956a24f9b2c370f0fe38821b2887c367948575"


def test_driver_ids():
    assert ids.repo_id("/r") == REPO
    assert ids.project_id(REPO) == PROJECT
    assert ids.worktree_id("/r") == WORKTREE
    assert ids.scope_id("/r") == SCOPE


def test_column_ids(spark):
    path, n = F.lit("src/main.rs"), F.lit(7)
    row = spark.range(1).select(
        ids.file_id(PROJECT, SCOPE, path).alias("file"),
        ids.symbol_id(path, F.lit("main"), n, n).alias("symbol"),
        ids.import_id(F.lit(FILE), F.lit("auth"), F.lit(1)).alias("import_"),
        ids.chunk_id(F.lit(FILE), F.lit("main"), n, n).alias("chunk"),
        ids.import_target_id(F.lit("auth")).alias("target"),
        ids.stable_hash(F.lit(None).cast("string"), "x").alias("nothing"),
        ids.stable_hash(F.lit("é"), "x").alias("accent"),
    ).first()
    assert (row["file"], row["symbol"], row["import_"], row["chunk"], row["target"]) == (FILE, SYMBOL, IMPORT, CHUNK, TARGET)
    assert row["nothing"] is None
    assert row["accent"] == ids.stable_hash_text("é", "x")


def test_scopes_differ(spark):
    row = spark.range(1).select(ids.file_id("p", "a", F.lit("x")).alias("a"), ids.file_id("p", "b", F.lit("x")).alias("b")).first()
    assert row["a"] != row["b"]
