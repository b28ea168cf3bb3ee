"""Tables written as dump files and read back through the data source."""

from heaplake.model import Heap
from heaplake.sources.export import export_hprof

from . import fixtures as fx


def test_export_round_trip(spark, tmp_path):
    for name, data in (("a", fx.f2()), ("b", fx.f1(4)), ("c", fx.f4())):
        h = Heap.from_bytes(spark, data)
        folder = str(tmp_path / name)
        written = export_hprof(h, folder)
        again = Heap.read(spark, folder)
        assert again.id_size == h.id_size
        for table, n in written.items():
            keep = [c for c in h[table].columns if c not in ("position", "raw")]
            want, got = (sorted(map(str, x[table].select(keep).collect())) for x in (h, again))
            assert want == got and len(got) == n, table
