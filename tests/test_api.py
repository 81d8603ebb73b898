import pytest

import gristmill


def test_public_names():
    for name in gristmill.__all__:
        assert getattr(gristmill, name).__name__ == name
    with pytest.raises(AttributeError):
        gristmill.nothing
