"""Query language: parser, syntax tree, planner and the registered queries."""
