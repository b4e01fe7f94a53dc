"""Schemas of the domain tables, as DDL strings that ``spark.read.schema`` takes."""

SCHEMAS = {
    "products": "id string, title string, description string, category string, brand string, "
    "seller_id string, price double, currency string, rating double, rating_count int, "
    "tags array<string>, material string, created_at date",
    "reviews": "id string, product_id string, author string, rating int, title string, body string, "
    "verified_purchase boolean, helpful_votes int, created_at date, is_fake_synthetic boolean",
    "transactions": "id string, product_id string, buyer_id string, quantity int, amount double, "
    "payment_method string, shipping_region string, billing_region string, buyer_account_age_days int, "
    "created_at timestamp_ntz, is_fraud_synthetic boolean",
    "inventory_history": "product_id string, date date, units_sold int, stock_level int, "
    "stockout boolean, restocked boolean",
    "pricing_inputs": "product_id string, elasticity double, marginal_cost double, "
    "reference_price double, reference_quantity int",
    "product_embeddings": "model string, dim int, ids array<string>, vectors array<array<float>>",
    "review_analysis": "review_id string, product_id string, sentiment_score double, "
    "aspects map<string,double>, fake_score double, likely_fake boolean",
    "product_review_summary": "product_id string, review_count bigint, avg_sentiment double, "
    "aspects array<struct<aspect:string,avg_sentiment:double,mentions:bigint>>, likely_fake_count bigint",
    "fraud_scores": "transaction_id string, fraud_score double, likely_fraud boolean, "
    "indicators struct<velocity:double,region_risk:double,new_account_high_value:double>",
    "inventory_forecasts": "product_id string, current_stock int, avg_daily_forecast double, "
    "forecast_horizon_days int, demand_std_dev double, reorder_point double, days_of_supply double, "
    "needs_reorder boolean, stockout_days_observed bigint",
    "pricing_recommendations": "product_id string, elasticity double, marginal_cost double, "
    "current_price double, current_quantity double, current_revenue double, current_profit double, "
    "optimal_price double, optimal_quantity double, optimal_revenue double, optimal_profit double, "
    "price_change_pct double, profit_uplift_pct double, recommendation string, "
    "curve array<struct<price_multiplier:double,price:double,quantity:double,revenue:double,profit:double>>",
    "cart_events": "cart_id string, seq bigint, action string, product_id string, quantity int",
}

ATTRIBUTION_MAP = (
    "map<string, struct<commons_title:string, source_url:string, artist:string, license:string, "
    "license_url:string, extension:string, product_ids:array<string>>>"
)
