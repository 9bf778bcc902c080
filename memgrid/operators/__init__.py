"""Operators over tables of observations, edges and vectors."""
