"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. ``queries`` registers one query
per operator; each operator module has the general interface behind it.
"""
