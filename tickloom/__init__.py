"""tickloom: equity-bar and volatility analytics as Catalyst plans."""
