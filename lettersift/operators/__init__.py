"""Relational operators: index build, set algebra, threads, maintenance."""
