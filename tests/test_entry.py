import __spark_entry__ as driver


def test_optional_parts_may_be_missing():
    assert driver._optional("docloom.not_there.queries") is None
    assert driver._optional("not_there_at_all") is None
    assert driver._optional("docloom.plans.sql") is not None
