import pytest

from keystrata.functions.records import prefix_end
from keystrata.plans.maintenance import Segment, full_merge, merged_segment, new_number, plan_merge, removable
from keystrata.plans.positions import Fenced, LogPosition, ReplicaState, Stale, StorePosition, Superseded, WrongPosition, may_resume, reached


def segments(sizes_newest_first):
    n = len(sizes_newest_first)
    return [Segment(n - i, s) for i, s in enumerate(sizes_newest_first)]


def test_newest_run_of_the_lowest_tier():
    plan = plan_merge(segments([100, 120, 500, 450, 90, 110]), 2, 100)
    assert plan.segments == (6, 5) and not plan.drop


def test_drop_only_at_the_oldest():
    assert plan_merge(segments([500, 100, 100]), 2, 100).drop
    assert plan_merge(segments([100]), 2, 100) is None
    assert plan_merge(segments([100, 100]), 1, 100) is None
    assert plan_merge(segments([100, 100]), 0, 100).segments == (2, 1)


def test_holds_protect_newer_segments():
    assert plan_merge(segments([100, 100, 100, 100]), 2, 100, held=3).segments == (2, 1)
    assert plan_merge(segments([100, 100, 100]), 2, 100, held=1) is None


def test_merged_entry_is_sticky():
    old = [Segment(1, 5, 7, True), Segment(2, 5, 9)]
    assert merged_segment(plan_merge(old, 2, 100), old, 8) == Segment(1, 8, 9, True)
    assert full_merge(old[:1]) is None
    assert new_number([3, 9]) == 10 and new_number([]) == 1
    assert removable(["a"], ["a", "b"]) == ["b"]


@pytest.mark.parametrize("prefix,end", [(b"a", b"b"), (b"a\xff", b"b"), (b"\xff\xff", None), (b"", None), (b"a\xfe", b"a\xff")])
def test_prefix_end(prefix, end):
    assert prefix_end(prefix) == end


def test_positions_on_the_wire():
    p = StorePosition(3, 9, LogPosition(100, 60, 0xDEADBEEF, 12))
    assert len(p.log.pack()) == 28 and len(p.pack()) == 44
    assert StorePosition.unpack(p.pack()) == p
    with pytest.raises(ValueError):
        LogPosition.unpack(LogPosition(10, 10).pack())
    with pytest.raises(ValueError):
        LogPosition.unpack(b"short")


def at(term=1, segment=1, offset=0, seq=0):
    return StorePosition(term, segment, LogPosition(offset, max(0, offset - 1), 0, seq))


def test_reached_in_order_of_tests():
    zero = StorePosition()
    reached(zero, 0, zero, zero)
    with pytest.raises(Stale):
        reached(at(term=2, seq=1), 1, at(seq=5), zero)
    with pytest.raises(Superseded):
        reached(at(term=1, seq=1), 2, at(term=2, seq=9), at(term=2, seq=9))
    reached(at(seq=5), 1, zero, at(seq=5))
    with pytest.raises(Stale):
        reached(at(seq=6), 1, zero, at(seq=5))
    reached(at(segment=1, offset=50), 1, at(segment=2), zero)
    with pytest.raises(Stale):
        reached(at(segment=2, offset=50), 1, at(segment=2, offset=49), zero)


def test_resume_needs_nothing_dropped_from_there_on():
    assert may_resume(5, 1, [(4, True), (9, False), (12, False)]) == 1
    assert may_resume(5, 1, [(9, False), (12, True)]) is None
    assert may_resume(0, 1, [(9, False)]) is None
    assert may_resume(20, 1, [(9, False)]) is None


def test_terms_and_state(tmp_path):
    s = ReplicaState().promote()
    assert s.term == 1 and not s.fenced
    s = s.note_term(4)
    assert s.fenced
    with pytest.raises(Fenced):
        s.check_writable()
    assert s.promote().term == 5
    with pytest.raises(WrongPosition):
        s.advance(at(seq=1), at(term=4, seq=2))
    with pytest.raises(Fenced):
        s.advance(StorePosition(), at(term=3))
    s = s.advance(StorePosition(), at(term=4, seq=2))
    assert (s.term, s.seen, s.fenced) == (4, 4, False)
    path = str(tmp_path / "replica")
    s.save(path)
    assert ReplicaState.load(path) == s
    (tmp_path / "replica").write_text("{}")
    assert ReplicaState.load(path) == ReplicaState()
    assert ReplicaState.load(str(tmp_path / "none")) == ReplicaState()
