"""Registered queries: thin plans that apply the operators to the driver's tables."""
