import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """Awkward rows: nulls, empties, ties, repeats, a very long text; columns that operators use as names of their own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. It was fine.\nFooter line here", "en", "src0", 10),
        (2, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG. IT WAS FINE.\nFOOTER LINE HERE", "en", "src0", 10),
        (3, "", "en", "src1", 0),
        (4, None, None, None, None),
        (5, " \n\t ", "de", "src1", 4),
        (6, "one two", "de", "src10", 7),
        (7, "one two", "de", "src10", 7),
        (7, "one two", "de", "src10", 7),
        (8, "wort " * 60_000 + "Ende mit ä ö ü \U0001f600.", "de", "src0", None),
        (9, "Größe é ñ ß, mail a.b@x-y.example.com or +1 (743) 555-3824; 10.0.0.255 10.0.0.256; 4111 1111 1111 1111", "fr", "src11", 90),
        (None, "no identifier at all here my friend", "fr", "src11", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    names = "score digest key token host tokens n range end domain c_domain l0 whole __whole mix_whole mix_epoch mix_tokens mix_l0 __host __lines __kept lines kept clean_text __clean n_lines n_dropped toxicity __toxicity t component_id n_shingles keep_id group_size seq part formatted"
    return df.withColumns({name: F.lit(f"own {name}") for name in names.split()})


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def sf():
    return SF
