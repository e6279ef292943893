"""Record layouts as DDL strings; all amounts are doubles, all share counts are whole numbers in doubles."""

BARS = "ticker string, date date, close double"
DECISIONS = "run_id long, seq long, ticker int, action string, quantity double, price double"
SIGNALS = "agent string, ticker string, signal string, confidence double"
LOTS = "ticker string, quantity double, trade_price double"
POSITION = "long double, short double, long_cost_basis double, short_cost_basis double, short_margin_used double"
PORTFOLIO = f"cash double, margin_requirement double, margin_used double, positions map<string, struct<{POSITION.replace(' ', ': ').replace(',: ', ', ')}>>"
DECISION_MAP = "map<string, struct<action: string, quantity: double, confidence: double, reasoning: string>>"
RANKINGS = (
    "analysis_date string, rankings array<struct<rank: int, ticker: string, company_name: string, total_score: double, signal: string, ensemble_score: double, "
    "predicted_return_1y: double, market_cap: struct<value: double, category: string, display: string>, scores: struct<fundamental: double, enhanced_momentum: double>, "
    "metrics: struct<pe: double, pb: double, peg: double, roe: double, revenue_growth: double>, investor_scores: map<string, double>, factors: array<string>, "
    "investor_warnings: array<string>, investor_consensus: struct<level: string>>>"
)
ANALYSES = "map<string, struct<signal: string, confidence: double, reasoning: string>>"
EVENTS = "type string, agent string, ticker string, status string, timestamp string, analysis string, message string, data string"
BACKTEST_REQUEST = (
    "tickers array<string>, start_date string, end_date string, initial_capital double, margin_requirement double, model_name string, model_provider string, "
    "portfolio_positions array<struct<ticker: string, quantity: double, trade_price: double>>"
)
NODES = "id string, type string, data string"
EDGES = "id string, source string, target string"
