"""Names that functions take from their module must exist there; queries run only when asked for."""

import builtins
import importlib
import pkgutil
import symtable
from pathlib import Path

import panelrisk


def unknown_names(path, known):
    todo, lost = [symtable.symtable(Path(path).read_text(), path, "exec")], []
    while todo:
        scope = todo.pop()
        todo += scope.get_children()
        if scope.get_type() == "function":
            lost += [(scope.get_name(), s.get_name()) for s in scope.get_symbols()
                     if s.is_global() and s.is_referenced() and s.get_name() not in known]
    return lost


def test_every_name_is_known():
    for found in pkgutil.walk_packages(panelrisk.__path__, "panelrisk."):
        module = importlib.import_module(found.name)
        assert unknown_names(module.__file__, set(vars(module)) | set(dir(builtins))) == [], found.name
