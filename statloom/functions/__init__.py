"""Scalar building blocks: special functions, missing values, small frame helpers."""
