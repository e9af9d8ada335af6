import pytest

from triplane.edn import Keyword, Symbol, read, read_all, write


def test_forms():
    assert read('[:find ?e . "a\\n" 1 2.5 -3 nil true #{1} {:a [1 (f x)]}]') == [":find", "?e", ".", "a\n", 1, 2.5, -3, None, True, frozenset({1}), {":a": [1, ("f", "x")]}]
    assert isinstance(read(":a/b"), Keyword) and isinstance(read("?x"), Symbol)
    assert read_all("1 ; note\n #_2 3") == [1, 3]
    assert read('#"a\\d"') == "a\\d" and read("1/2") == 0.5 and read("\\newline") == "\n"


@pytest.mark.parametrize("text", ["[1 2", "{:a}", ")", ""])
def test_errors(text):
    with pytest.raises(ValueError):
        read(text)


@pytest.mark.parametrize("text", ['[:a ?b "c\\"d" 1 2.5 nil true]', '{:a (f 1 2), :b [3]}'])
def test_round_trip(text):
    assert read(write(read(text))) == read(text)
