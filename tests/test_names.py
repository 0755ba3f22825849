"""Every name that a function of the library looks up is there."""

import builtins
import importlib
import pkgutil
import types

import pytest

import lodestone

MODULES = [m.name for m in pkgutil.walk_packages(lodestone.__path__, "lodestone.") if not m.ispkg]


def looked_up(code):
    """The global names of a function's code and of the functions inside it."""
    import dis

    for i in dis.get_instructions(code):
        if i.opname == "LOAD_GLOBAL":
            yield i.argval
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from looked_up(c)


@pytest.mark.parametrize("name", MODULES)
def test_names_are_known(name):
    """an import that a function needs may be missing until the function runs."""
    module = importlib.import_module(name)
    own = [f for f in vars(module).values() if isinstance(f, types.FunctionType) and f.__module__ == name]
    missing = {(f.__name__, x) for f in own for x in looked_up(f.__code__) if x not in vars(module) and not hasattr(builtins, x)}
    assert not missing
