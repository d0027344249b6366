"""Training-data operators: ten independent modules, each with a general interface, and the
thin ``opN_*`` queries over the shared tables in :mod:`lakeloom.llm.queries`.

Nothing else in the library imports this subpackage.
"""
