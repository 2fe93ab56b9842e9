"""Functions go to the workers by value, so whatever they name must be picklable."""

import importlib
import inspect

import pytest
from pyspark import cloudpickle

MODULES = ("bpe", "gridjoin", "iblt", "langid", "linechunks", "mixing", "periods", "pii", "rules", "simhash", "spelling", "suffixes", "warc")


@pytest.mark.parametrize("name", MODULES)
def test_functions_are_picklable(name):
    module = importlib.import_module(f"leafledger.llm.{name}")
    for function in (f for _, f in inspect.getmembers(module, inspect.isfunction) if f.__module__ == module.__name__):
        cloudpickle.dumps(function)
