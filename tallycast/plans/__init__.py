"""End-to-end compositions: scoring, forecasting routes, output assembly."""
