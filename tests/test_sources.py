import pytest

from lodestone.sources.xyz import parse_frames, register, to_xyz
from lodestone.streaming.files import stream_xyz

EL, POS, CELL = ["Cs", "Te"], [[0.0, 0.1, 0.2], [1.5, 2.5, 3.5]], [[4.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 6.0]]


def test_round_trip_and_stream(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(to_xyz(EL, POS, CELL, "x") + to_xyz(EL[:1], POS[:1]))
    register(spark)
    rows = sorted(spark.read.format("xyz").load(str(tmp_path)).collect(), key=lambda r: r.frame)
    assert [(r.elements, r.positions, r.cell) for r in rows] == [(EL, POS, CELL), (EL[:1], POS[:1], None)]
    q = stream_xyz(spark, str(tmp_path)).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("frames").count() == 2


def test_broken_file():
    with pytest.raises(ValueError, match="frame 0"):
        list(parse_frames(iter(["3\n", "c\n", "Te 0 0 0\n"]), "f"))
