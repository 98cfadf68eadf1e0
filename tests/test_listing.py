import pytest

from thingfleet.sources.listing import Listing


def rows(n):
    return [(f"t{i:05d}", None if i % 10 == 0 else i * 7919 % 13, i) for i in range(n)]


def key(row):
    return (row[1] is not None, row[1] or 0, row[0])  # nulls first, ties by id


@pytest.fixture(scope="module")
def listing(spark):
    things = spark.createDataFrame(rows(1000), "id string, w int, seq int").repartition(7)
    return Listing.build(things, "w", block=16)


def test_pages_are_those_of_the_whole_sort(listing):
    wanted = sorted(rows(1000), key=key)
    for limit, offset in ((10, 0), (20, 5), (40, 300), (16, 984), (30, 990), (5, 1000), (5, 10**12), (0, 3), (1000, 0)):
        got = [(r.at, *r.thing) for r in listing.page(limit, offset).collect()]
        assert got == [(i, *wanted[i]) for i in range(offset, min(offset + limit, 1000))], (limit, offset)


def test_a_page_reads_its_blocks_only(listing):
    assert listing.directory().count() >= 1000 // 16
    page = listing.page(20, 700)
    parts = [f for f in page.inputFiles() if "/rows/" in f]
    assert 2 <= len(parts) <= 4
    read = listing.spark.read.parquet(*parts).count()
    assert read <= 4 * 16


def test_order_runs_downwards_with_nulls_last(spark):
    things = spark.createDataFrame(rows(50), "id string, w int, seq int")
    got = [r.thing.w for r in Listing.build(things, "w", "desc", block=7).page(50).collect()]
    seen = [w for w in got if w is not None]
    assert seen == sorted(seen, reverse=True) and got[len(seen) :] == [None] * 5


def test_collections_know_their_neighbours(spark, listing):
    one = listing.collection(20, 20).first()
    assert (one.id, one.total) == ("/things?offset=20&limit=20&format=collection", 1000)
    assert one.next == "/things?offset=40&limit=20&format=collection"
    assert [m.id for m in one.members] == [r[0] for r in sorted(rows(1000), key=key)[20:40]]
    last = listing.collection(20, 980).first()
    assert last.next is None and len(last.members) == 20
    empty = Listing.build(spark.createDataFrame([], "id string, w int")).collection(5).first()
    assert (empty.total, empty.next, empty.members) == (0, None, [])


def test_wrong_arguments_are_refused(spark, listing):
    with pytest.raises(ValueError):
        listing.page(-1)
    with pytest.raises(ValueError):
        Listing.build(spark.createDataFrame(rows(1), "id string, w int, seq int"), sort_order="up")
