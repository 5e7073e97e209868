"""Whole dataflows put together from functions and operators."""
