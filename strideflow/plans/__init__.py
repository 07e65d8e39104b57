"""strideflow.plans"""
